"""N-gram Jaccard self-join with vertical partitioning.

A text's set is its distinct word shingles. All n-grams have one global order, which is cut into fragments.
A pair's overlap is counted in each fragment apart, and the partial counts are summed per pair.

Which pairs are counted at all follows from prefixes, without loss:

1. Sets that are equal form one class; only classes are joined.
2. In the order of hashes, two linked sets of sizes m and n have at least k = min(m, n) / 8 shingles in common
   among the first n - ceil(3n/4) + n/8 of each (the prefix). Only prefixes are shuffled. Each prefix shingle's
   number of classes is counted. Rarest first, linked sets also share one of the first (prefix length - k + 1). A
   shingle that one class alone has links nothing, so a text with enough of its own is done here.
3. The whole sets of what is left are counted in the same way, where k is 1: rarest first, linked sets share one
   of their first n - ceil(3n/4) + 1 shingles. Few texts but real candidates have one there that is not their own.
4. Classes that share such a shingle are first compared with one of them (the pivot: the one with the fewest shingles
   of its own) only; linked ones fall into components. Of the pairs that still lie in different components, those
   are counted that can be linked at all: two sets have in common at most what both have in common with the pivot and
   what both have besides it and their own. So a group of thousands of near copies costs about one comparison each,
   and no link is lost.

A shingle that a hundredth of a batch of documents holds is named frequent where it is met, so its holders
never gather in one task. Fingerprints of sets have 64 bits, and so have the shingles that confirm a link. Shingles
have 48 bits where candidates are counted; where a set is so large that two of its own may agree in those, the bounds
give way by as much. The number of parts follows from the input's size, so a task's share has a bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitfilter
from .components import components
from .scratch import Scratch
from .words import Hashes, grams, lower_ascii, mix, parts_for, words

SHINGLE = 5
FRAGMENTS = 4
#: Documents that a task holds the sets of at a time.
BATCH = 4000
#: Bytes of text whose shingles a part counts.
PART_BYTES = 16_000_000
FREQUENT = 2**31 - 1


def shingle_set(text: str | None, hashes: Hashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles. A text of fewer words is one shingle; without words, none."""
    w = words(lower_ascii(text)) if text else []
    return np.unique(grams(hashes.of(w), min(size, len(w)))) if w else np.zeros(0, np.uint64)


def class_print(s: np.ndarray) -> int:
    """64-bit fingerprint of a set."""
    return int(mix(np.array([np.sum(mix(s ^ np.uint64(0xA5A5A5A5))), len(s)], np.uint64)).sum() >> np.uint64(1))


def needed(n: int) -> int:
    """Shingles that a set of n has in common with any linked one at least: ceil(3n / 4)."""
    return -(-3 * n // 4)


def prefix_length(n: int) -> int:
    return n - needed(n) + max(1, n // 8)


def rare_length(n: int) -> int:
    """Rarest shingles of a prefix among which linked sets share one."""
    return prefix_length(n) - max(1, needed(n) // 8) + 1


def slack(n: int) -> int:
    """How many of a set's 48-bit numbers may fall together, generously: none below a million."""
    return 2 * n // 1_000_000


def _pack(tokens: np.ndarray) -> bytes:
    """48-bit numbers as six bytes each."""
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


_ROUTE = "key int, frequent boolean, owners binary, sizes binary, tokens binary, holders binary"
_ROUTE_NAMES = ["key", "frequent", "owners", "sizes", "tokens", "holders"]


def _route(key: int, frequent: bool, owners: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, holders: np.ndarray) -> tuple:
    return key, frequent, owners.tobytes(), sizes.astype(np.uint32).tobytes(), _pack(tokens), holders.astype(np.uint16).tobytes()


def _routes(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.bool_(), *[pa.binary()] * 4))], _ROUTE_NAMES)


def _dealt(owners: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, holders: np.ndarray, parts: int) -> pa.RecordBatch:
    """A batch's shingles. Rows for shingles go to the part that counts those (key >= 0); frequent ones leave a
    note there, and their holders' rows go to the holders' own part. holders: which owner each token is of."""
    order = np.argsort(tokens, kind="stable")
    tokens, holders = tokens[order], holders[order]
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    times = np.diff(np.append(first, len(tokens)))
    often = times >= max(64, len(owners) // 100)
    common = np.repeat(often, times)
    key = (tokens >> np.uint64(24)).astype(np.int64) % parts
    out = []

    def rows(mask: np.ndarray, by: np.ndarray, name, frequent: bool) -> None:  # noqa: ANN001
        k = np.flatnonzero(mask)
        k = k[np.argsort(by[k], kind="stable")]
        cut = np.searchsorted(by[k], np.arange(parts + 1))
        for p in range(parts):
            at = k[cut[p] : cut[p + 1]]
            if len(at):
                who, local = np.unique(holders[at], return_inverse=True)
                out.append(_route(name(p), frequent, owners[who], sizes[who], tokens[at], local))

    rows(~common, key, lambda p: p, False)
    notes, where = tokens[first[often]], key[first[often]]
    for p in np.unique(where):
        out.append(_route(int(p), True, owners[:0], sizes[:0], notes[where == p], holders[:0]))
    if common.any():
        rows(common, owners[holders] % parts, lambda p: -1 - p, True)
    return _routes(out)


def _prefixes(docs: DataFrame, parts: int, size: int) -> DataFrame:
    """Prefixes of each batch's classes, dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in (w.slice(i, BATCH) for w in batches for i in range(0, w.num_rows, BATCH)):
            sets = {}
            for t in b.column(0):
                s = shingle_set(t.as_py(), hashes, size)
                if len(s):
                    sets.setdefault(class_print(s), s)
            if sets:
                pieces = [s[: prefix_length(len(s))] >> np.uint64(16) for s in sets.values()]
                yield _dealt(np.array(list(sets), np.int64), np.array([len(s) for s in sets.values()]), np.concatenate(pieces), np.repeat(np.arange(len(pieces)), [len(p) for p in pieces]), parts)

    return docs.mapInArrow(run, _ROUTE)


def _whole(sets: DataFrame, parts: int) -> DataFrame:
    """All shingles of the sets' rows, dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pieces = [np.frombuffer(x.as_py(), np.uint64) >> np.uint64(16) for x in b.column(2)]
            owners, first, local = np.unique(b.column(0).to_numpy(), return_index=True, return_inverse=True)
            if sum(map(len, pieces)):
                yield _dealt(owners, b.column(1).to_numpy()[first], np.concatenate(pieces), np.repeat(local, [len(p) for p in pieces]), parts)

    return sets.select("owner", "n", "tokens").mapInArrow(run, _ROUTE)


def _count(parts: int):  # noqa: ANN202
    """For a part of the shingles: how many classes hold each; rows for the holders of shared ones, by holder."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        tokens, owners, sizes, named = [], [], [], []
        out = []
        for r in rows:
            if r["key"] < 0:
                out.append((-1 - r["key"], r["owners"], r["sizes"], r["tokens"], r["holders"], np.full(len(r["holders"]) // 2, FREQUENT, np.int32).tobytes()))
                continue
            t = _unpack(r["tokens"])
            if r["frequent"]:
                named.append(t)
                continue
            local = np.frombuffer(r["holders"], np.uint16)
            tokens.append(t)
            owners.append(np.frombuffer(r["owners"], np.int64)[local])
            sizes.append(np.frombuffer(r["sizes"], np.uint32)[local])
        if tokens:
            t, o, n = np.concatenate(tokens), np.concatenate(owners), np.concatenate(sizes)
            order = np.lexsort((o, t))
            t, o, n = t[order], o[order], n[order]
            keep = np.concatenate([[True], (t[1:] != t[:-1]) | (o[1:] != o[:-1])])
            t, o, n = t[keep], o[keep], n[keep]
            first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            times = np.diff(np.append(first, len(t)))
            df = np.repeat(times, times)
            if named:
                df[np.isin(t, np.concatenate(named))] = FREQUENT
            t, o, n, df = (x[df > 1] for x in (t, o, n, df))
            key = o % parts
            for p in np.unique(key):
                at = np.flatnonzero(key == p)
                for i in range(0, len(at), 60_000):  # holders are numbered with 16 bits
                    s = at[i : i + 60_000]
                    who, where, local = np.unique(o[s], return_index=True, return_inverse=True)
                    out.append((int(p), who.tobytes(), n[s][where].astype(np.uint32).tobytes(), _pack(t[s]), local.astype(np.uint16).tobytes(), df[s].astype(np.int32).tobytes()))
        cols = list(zip(*out)) if out else [()] * 6
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), *[pa.binary()] * 5))], names=["part", "owners", "sizes", "tokens", "holders", "df"])

    return run


def _rarest(table: pa.Table, extra) -> tuple[np.ndarray, ...]:  # noqa: ANN001
    """For a part of the classes: (class, shingle, size, shared shingles) of each one's rarest shingles that another class has too, as
    far as needed. extra(n): how many of a set's dealt shingles need not be looked at, rarest first."""
    tokens, owners, sizes, counts = [], [], [], []
    for r in table.to_pylist():
        local = np.frombuffer(r["holders"], np.uint16)
        tokens.append(_unpack(r["tokens"]))
        owners.append(np.frombuffer(r["owners"], np.int64)[local])
        sizes.append(np.frombuffer(r["sizes"], np.uint32)[local])
        counts.append(np.frombuffer(r["df"], np.int32))
    t, o, n, df = (np.concatenate(x) for x in (tokens, owners, sizes, counts))
    order = np.lexsort((t, df, o))
    t, o, n = t[order], o[order], n[order].astype(np.int64)
    # A class met in several batches says the same of a frequent shingle each time.
    keep = np.concatenate([[True], (t[1:] != t[:-1]) | (o[1:] != o[:-1])])
    t, o, n = t[keep], o[keep], n[keep]
    first = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
    shared = np.diff(np.append(first, len(t)))
    # Those that no other class has come before all of these.
    most = shared - np.array([extra(int(x)) - slack(int(x)) for x in n[first]])
    take = np.arange(len(t)) - np.repeat(first, shared) < np.repeat(most, shared)
    return o[take], t[take], n[take], np.repeat(shared, shared)[take]


def _candidates(table: pa.Table) -> pa.Table:
    o, *_ = _rarest(table, lambda n: prefix_length(n) - rare_length(n))
    return pa.Table.from_arrays([pa.array(np.unique(o))], names=["owner"])


def _choose(table: pa.Table) -> pa.Table:
    o, t, n, shared = _rarest(table, lambda n: needed(n) - 1)
    return pa.Table.from_arrays([pa.array(o), pa.array(t.astype(np.int64)), pa.array(n), pa.array(n - shared)], names=["owner", "token", "n", "u"])


def _meta_and_sets(docs: DataFrame, asked: np.ndarray, size: int) -> DataFrame:
    """Second pass: id, set size and class of every row; sets of those classes that the filter lets through,
    once a batch, in fragments of the global order."""
    shared = docs.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits = Hashes(), shared.value
        for b in (w.slice(i, BATCH) for w in batches for i in range(0, w.num_rows, BATCH)):
            n, owner, out, done = [], [], [], set()
            for t in b.column(1):
                s = shingle_set(t.as_py(), hashes, size)
                c = class_print(s) if len(s) else None
                n.append(len(s))
                owner.append(c)
                if c is None or c in done:
                    continue
                done.add(c)
                if bitfilter.passes(bits, np.array([c]))[0]:
                    cut = [0, *np.searchsorted(s, np.arange(1, FRAGMENTS, dtype=np.uint64) * np.uint64((1 << 64) // FRAGMENTS)), len(s)]
                    out += [(c, len(s), f, s[cut[f] : cut[f + 1]].tobytes()) for f in range(FRAGMENTS)]
            k = len(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(owner, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], ["doc_id", "n", "owner", "fragment", "tokens"])
            if out:
                c, m, f, x = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(out), pa.int64()), pa.array(m, pa.int64()), pa.array(c, pa.int64()), pa.array(f, pa.int32()), pa.array(x, pa.binary())], ["doc_id", "n", "owner", "fragment", "tokens"])

    return docs.mapInArrow(run, "doc_id long, n long, owner long, fragment int, tokens binary")


#: Cells of a fragment in which an overlap with a pivot is counted apart.
CELLS = 16


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        common = [np.intersect1d(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), assume_unique=True) for x, y in zip(b.column(3), b.column(4))]
        # A fragment is two leading bits of 64; its cells are the four bits after those.
        cells = [np.bincount((t >> np.uint64(58)).astype(np.int64) & (CELLS - 1), minlength=CELLS).astype(np.int32) for t in common]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([len(t) for t in common], pa.int64()), pa.array(cells, pa.list_(pa.int32()))], ["a", "b", "fragment", "common", "cells"])


def _sets_of(sets: DataFrame, pairs: DataFrame, side: str, name: str, parts: int) -> DataFrame:
    """The sets of one side of the pairs, and few others: most sets are in no pair, and are not shuffled for any."""
    shared = sets.sparkSession.sparkContext.broadcast(bitfilter.build(pairs, side, parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(bitfilter.passes(shared.value, b.column(0).to_numpy())))

    return sets.select(F.col("owner").alias(side), "fragment", F.col("tokens").alias(name)).mapInArrow(run, f"{side} long, fragment int, {name} binary")


def count_overlaps(pairs: DataFrame, sets: DataFrame, parts: int = 2) -> DataFrame:
    """(a, b, common, cells) of each pair: overlap counted in each fragment, then summed; cells: the overlap in each
    cell of the whole order. sets: owner, n, fragment, tokens; owners are not negative."""
    left, right = _sets_of(sets, pairs, "a", "x", parts), _sets_of(sets, pairs, "b", "y", parts)
    parts = pairs.select("a", "b").join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "fragment", "x", "y").mapInArrow(_overlap, "a long, b long, fragment int, common long, cells array<int>")
    cells = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("fragment", "cells"))), lambda p: p["cells"]))
    return parts.groupBy("a", "b").agg(F.sum("common").alias("common"), cells.alias("cells"))


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Two texts are linked when 100 * intersection >= 75 * union of their sets of ``shingle``-word shingles.
    component_id is the smallest doc_id that links lead to. Null texts and texts without words have no shingles,
    are linked with nothing, and keep their own id. Repeated rows fall into one component; null ids never name
    one. ids are read as long. An empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    parts = parts_for(source, "text", PART_BYTES)
    counted = "part int, owners binary, sizes binary, tokens binary, holders binary, df binary"
    routed = _prefixes(source.select("text"), parts, shingle).groupBy("key").applyInArrow(_count(parts), counted)
    maybe = scratch.save(routed.groupBy("part").applyInArrow(_candidates, "owner long"), "maybe")
    rows = scratch.save(_meta_and_sets(source, bitfilter.build(maybe, "owner", parts), shingle), "rows")
    sets = scratch.save(rows.filter("fragment is not null").join(maybe, "owner", "left_semi").groupBy("owner", "fragment").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens")), "sets")
    routed = _whole(sets, parts).groupBy("key").applyInArrow(_count(parts), counted)
    held = scratch.save(routed.groupBy("part").applyInArrow(_choose, "owner long, token long, n long, u long"), "held")
    wanted = held.select("owner").distinct()
    # Linked sets differ in (m + n) / 7 shingles at most, and in all of those that no other class has.
    fits = "4 * least(m, n) >= 3 * greatest(m, n) and 7 * (u + v) <= m + n + (m + n) div 50000"

    # One pivot for each shingle and size class, the one with the fewest shingles of its own: near copies of a text
    # are nearer to it than to each other. Linked sets lie in the same or adjacent size classes, so a set is a member of
    # its own class's pivot and of the next one's: any two that can be linked are members of one pivot.
    step = F.floor(F.log("n") / F.log(F.lit(4 / 3)) + 1e-9).cast("int")
    sized = held.withColumn("step", step)
    pivots = scratch.save(sized.groupBy("token", "step").agg(F.min(F.struct("u", "owner", "n")).alias("p")).select("token", "step", F.col("p.owner").alias("pivot"), F.col("p.n").alias("m"), F.col("p.u").alias("v")), "pivots")
    both = sized.select("owner", "n", "u", "token", F.explode(F.array(F.col("step"), F.col("step") + 1)).alias("step"))
    members = scratch.save(both.join(pivots, ["token", "step"]).select("owner", "n", "u", "pivot", "m", "v").distinct(), "members")
    stars = members.filter("owner != pivot and " + fits).select(F.col("owner").alias("a"), F.col("pivot").alias("b"))
    size = sets.filter("fragment = 0").select("owner", "n")

    def counted_links(pairs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        counted = scratch.save(count_overlaps(pairs, sets, parts), f"counted-{name}")
        sized_pairs = counted.join(size.select(F.col("owner").alias("a"), F.col("n").alias("m")), "a").join(size.select(F.col("owner").alias("b"), "n"), "b")
        return counted, scratch.save(sized_pairs.filter("100 * common >= 75 * (m + n - common)").select("a", "b"), f"links-{name}")

    counted, links = counted_links(stars, "stars")
    labels = components(links, scratch, "labels")
    named = labels.withColumnRenamed("node", "owner")
    # c: overlap with the pivot; o: what a class shares with others besides. Where sizes or own shingles already forbid
    # a link with the pivot, neither is known.
    known = counted.select(F.col("a").alias("owner"), F.col("b").alias("pivot"), F.col("common").alias("c"), "cells")
    c = F.when(F.col("owner") == F.col("pivot"), F.col("n")).otherwise(F.col("c"))
    around = members.select("owner", "n", "u", "pivot").join(known, ["owner", "pivot"], "left").join(named, "owner", "left").select("owner", "n", "u", "pivot", F.coalesce("label", "owner").alias("label"), F.coalesce(c, "n").alias("c"), F.when(c.isNull(), F.col("n")).otherwise(F.col("n") - c - F.col("u")).alias("o"), "cells")
    around = scratch.save(around, "around")
    # Pivots whose classes are all in one component by now have nothing left to say among themselves.
    several = around.groupBy("pivot").agg(F.min("label").alias("l"), F.max("label").alias("h")).filter("l != h").select("pivot")
    x = around.select("pivot", F.col("owner").alias("a"), F.col("n").alias("m"), F.col("u").alias("v"), F.col("label").alias("la"), F.col("c").alias("ca"), F.col("o").alias("oa"), F.col("cells").alias("xa"))
    y = around.select("pivot", F.col("owner").alias("b"), "n", "u", F.col("label").alias("lb"), F.col("c").alias("cb"), F.col("o").alias("ob"), F.col("cells").alias("xb"))
    # Two sets have in common what both have of the
    # pivot at most, cell by cell, and of the rest what both could share.
    by_cell = F.coalesce(F.aggregate(F.zip_with("xa", "xb", lambda p, q: F.least(p, q)), F.lit(0), lambda s, p: s + p), F.least("ca", "cb"))
    same = x.join(several, "pivot", "left_semi").join(y, "pivot").filter("la < lb and " + fits + " and 7 * (least(ca, cb) + least(oa, ob) + (m + n) div 350000) >= 3 * (m + n)").filter(7 * (by_cell + F.least("oa", "ob") + F.expr("(m + n) div 350000")) >= 3 * (F.col("m") + F.col("n"))).select("a", "b")
    order = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = scratch.save(order(same).join(order(counted), ["a", "b"], "left_anti"), "pairs")
    if pairs.head(1):
        _, more = counted_links(pairs, "rest")
        if more.head(1):
            labels = components(links.union(more), scratch, "labels-all")
    meta = rows.filter("fragment is null").select("doc_id", "n", "owner")
    # Without a label of its own, a class is its own component.
    full = scratch.save(meta.join(labels.withColumnRenamed("node", "owner"), "owner", "left").select("doc_id", "n", F.coalesce("label", "owner").alias("label")), "full")
    low = scratch.save(full.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("low")), "low")
    scratch.keep_only("full", "low")
    return full.join(low, "label", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("low")).alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their component: the one with its smallest id. Rows with a null id stay."""
    found = similar_groups(docs, doc_id, text).filter("doc_id is not null and doc_id != component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(found.hint("merge"), F.col(f"`{doc_id}`") == F.col("_gone"), "left_anti")
