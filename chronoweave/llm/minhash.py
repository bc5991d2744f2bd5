"""Near-duplicates by b-bit MinHash.

A text's set is its distinct word shingles; texts with equal sets are one class. A class has BANDS times ROWS minima. A
band's minima together are a key; classes that share a key are candidates. Of every minimum the BITS lowest bits of its
hash are kept and packed, so a signature has 48 bytes, and the share of equal entries, corrected for those that agree by
chance, estimates the similarity of two classes. Candidates whose estimate is at least SURE are confirmed on full sets.

What can be lost: two texts at the least similarity of 0.8 share no band with a probability of (1 - 0.8^4)^48 = 1e-11,
and their estimate is seven standard deviations too low with one of 1e-12. Nothing else is left out:

1. The smallest class of a bucket is its pivot, so near copies have few pivots. Classes whose estimate with one of their
   pivots is at least SURE form families; where a bucket still holds several families, members of different ones are compared
   by their signatures, in blocks of BLOCK members, and families with a pair at SURE or more are one.
2. A family's members are compared with each other on full sets, in pairs of blocks of bounded size. Of a pair of blocks,
   only links that join what was not joined yet are handed on, so a group of thousands of near copies needs few
   comparisons and gives few rows, and texts that look alike without a link give none.

Texts move only in families, one of each class. A large family or bucket is dealt out by pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bitfilter
from .components import components
from .jaccard import shingle_set
from .scratch import Scratch
from .words import Hashes, mix, parts_for

SHINGLE = 4
#: Least similarity of linked sets, in percent.
PERCENT = 80
BANDS, ROWS, BITS = 48, 4, 2
#: Candidates with estimates from here on are confirmed: the least similarity less seven standard deviations of the estimate.
SURE = 0.56
#: Documents that a task holds the sets of at a time, and shingles.
BATCH, MOST_SHINGLES = 500, 1 << 15
#: Bytes of text that a part confirms.
PART_BYTES = 16_000_000
#: Members of a bucket that are compared with as many others at a time.
BLOCK = 2048
#: Members of a family, and shingles of their sets, that are compared with as many others at a time.
FAMILY, FAMILY_SHINGLES = 4096, 1_500_000

_seeds = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS, _SHIFTS = _seeds[::2] | np.uint64(1), _seeds[1::2]
#: Chance agreement of the kept bits.
CHANCE = 1 / (1 << BITS)


def set_print(s: np.ndarray) -> bytes:
    """128-bit fingerprint of a set; its first bit is 0."""
    halves = [int(mix(np.array([np.sum(mix(s ^ np.uint64(k))), len(s)], np.uint64)).sum()) for k in (0xA5A5A5A5, 0x5A5A5A5A5A)]
    return (halves[0] >> 1).to_bytes(8, "big") + halves[1].to_bytes(8, "big")


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BANDS * ROWS) minima of the hash functions over sets that are not empty."""
    h, first = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), BANDS * ROWS), np.uint64)
    for j in range(BANDS * ROWS):
        out[:, j] = np.minimum.reduceat(h * _FACTORS[j] + _SHIFTS[j], first)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    """63-bit keys of the bands."""
    keys = np.tile(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(m), 1))
    for i in range(ROWS):
        keys = mix(keys * np.uint64(0x100000001B3) + m[:, i::ROWS])
    return (keys >> np.uint64(1)).astype(np.int64)


def signatures(m: np.ndarray) -> np.ndarray:
    """The lowest bits of the minima's hashes, packed in 64-bit words."""
    low = (mix(m) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    bits = np.stack([(low >> i) & 1 for i in range(BITS)], axis=-1).reshape(len(m), -1)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


_EVEN = np.uint64(0x5555555555555555)


def estimates(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated similarities of signatures (last axis: their words): the share of minima whose kept bits agree, less
    what agrees by chance."""
    apart = x ^ y
    agree = 1 - np.bitwise_count((apart | (apart >> np.uint64(1))) & _EVEN).sum(axis=-1, dtype=np.int64) / (BANDS * ROWS)
    return (agree - CHANCE) / (1 - CHANCE)


def _words_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), -1)


def _sketched(docs: DataFrame, size: int) -> DataFrame:
    """Rows of texts (doc_id, n, class) and, once for each class of a batch, of classes (class, n, signature, bands)."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Ids and sets of a few texts: BATCH texts or MOST_SHINGLES shingles, and one text at least."""
        hashes = Hashes()
        ids, sets, held = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0), b.column(1)):
                sets.append(shingle_set(t.as_py(), hashes, size))
                ids.append(i.as_py())
                held += len(sets[-1])
                if len(ids) >= BATCH or held >= MOST_SHINGLES:
                    yield ids, sets
                    ids, sets, held = [], [], 0
        if ids:
            yield ids, sets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for ids, sets in some(batches):
            prints = [set_print(s) if len(s) else None for s in sets]
            k = len(ids)
            yield _batch(ids, [len(s) for s in sets], prints, [None] * k, [None] * k)
            fresh = {c: s for c, s in zip(prints, sets) if c is not None and c not in seen}
            if len(seen) > 1_000_000:
                seen.clear()
            seen.update(fresh)
            if fresh:
                m = minima(list(fresh.values()))
                yield _batch([None] * len(m), [len(s) for s in fresh.values()], list(fresh), [x.tobytes() for x in signatures(m)], list(band_keys(m)))

    def _batch(ids: list, n: list, prints: list, marks: list, bands: list) -> pa.RecordBatch:
        cols = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(marks, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "class", "mark", "bands"])

    return docs.mapInArrow(run, "doc_id long, n long, class binary, mark binary, bands array<long>")


def _texts_of(docs: DataFrame, wanted: DataFrame, size: int, parts: int) -> DataFrame:
    """(class, text): a text of each wanted class, and by chance some others."""
    asked = bitfilter.build(wanted.select(_prefix(F.col("class")).alias("p")), "p", parts)
    shared = docs.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits, seen = Hashes(), shared.value, set()
        for b in batches:
            prints, texts = [], []
            for t in b.column(0):
                s = shingle_set(t.as_py(), hashes, size)
                c = set_print(s) if len(s) else None
                if c is not None and c not in seen and bitfilter.passes(bits, np.array([int.from_bytes(c[:8], "big")]))[0]:
                    seen.add(c)
                    prints.append(c)
                    texts.append(t.as_py())
            if len(seen) > 1_000_000:
                seen.clear()
            if prints:
                yield pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), pa.array(texts, pa.string())], ["class", "text"])

    return docs.select("text").mapInArrow(run, "class binary, text string")


def _prefix(c: Column) -> Column:
    return F.conv(F.hex(F.substring(c, 1, 8)), 16, 10).cast("long")


def _similar(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Pairs (a, b) with their estimate, of those whose sizes and estimates allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                e = estimates(_words_of(b.column(2)), _words_of(b.column(3)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(e)], ["a", "b", "estimate"])

    x = marks.select(F.col("id").alias("a"), F.col("mark").alias("x"), F.col("n").alias("m"))
    y = marks.select(F.col("id").alias("b"), F.col("mark").alias("y"), "n")
    met = pairs.join(x, "a").join(y, "b").filter(f"100 * least(m, n) >= {PERCENT} * greatest(m, n)")
    return met.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, estimate double").filter(F.col("estimate") >= SURE)


def _links(families: DataFrame, parts: int, size: int) -> DataFrame:
    """(a, b) of linked classes, enough of them to join all that links join. families: family, id, n, mark, text."""
    sizes = families.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / FAMILY), F.ceil(F.sum("n") / FAMILY_SHINGLES)).cast("int").alias("of"))
    rows = _paired(families.join(sizes, "family"), "family", ["n", "mark", "text"])
    dealt = rows.repartition(parts, "family", "i", "j").sortWithinPartitions("family", "i", "j")

    def confirm(group: list[tuple]) -> Iterator[tuple[int, int]]:
        """Links between the group's two blocks (or in its one) that join what is not joined yet."""
        i, j = group[0][1], group[0][2]
        side = np.array([r[3] == i for r in group])
        ids, n = [r[4] for r in group], np.array([r[5] for r in group])
        marks = np.frombuffer(b"".join(r[6] for r in group), "<u8").reshape(len(group), -1)
        joined = np.arange(len(group))
        index: tuple | None = None
        for p in range(len(group)):
            met = (joined != joined[p]) & (100 * np.minimum(n[p], n) >= PERCENT * np.maximum(n[p], n))
            met[: p + 1] = False
            if i != j:
                met &= side != side[p]
            at = np.flatnonzero(met)
            if not len(at) or not (estimates(marks[p], marks[at]) >= SURE).any():
                continue
            if index is None:
                hashes = Hashes()
                sets = [shingle_set(r[7], hashes, size) for r in group]
                tokens, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                order = np.argsort(tokens, kind="stable")
                index = tokens[order], owners[order], sets
            tokens, owners, sets = index
            low, high = np.searchsorted(tokens, sets[p], "left"), np.searchsorted(tokens, sets[p], "right")
            held = np.repeat(low - np.concatenate([[0], np.cumsum(high - low)[:-1]]), high - low) + np.arange((high - low).sum())
            common = np.bincount(owners[held], minlength=len(group))
            for q in np.flatnonzero((100 * common >= PERCENT * (n[p] + n - common)) & (joined != joined[p])):
                if joined[q] != joined[p]:
                    yield ids[p], ids[int(q)]
                    joined[joined == joined[q]] = joined[p]

    return dealt.mapInArrow(_by_group(confirm), "a long, b long").distinct()


def _paired(rows: DataFrame, key: str, carried: list[str]) -> DataFrame:
    """``rows`` (key, id, of: number of blocks) for each pair (i, j) of blocks that holds theirs, which is ``own``."""
    own = F.pmod(F.xxhash64("id"), F.col("of")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    return rows.select(key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", *carried)


def _by_group(work):  # noqa: ANN001, ANN202
    """A function for mapInArrow: ``work`` on each run of rows with equal first three columns; it yields (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []

        def done() -> Iterator[pa.RecordBatch]:
            found = list(work(group)) if len(group) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if group and r[:3] != group[0][:3]:
                    yield from done()
                    group = []
                group.append(r)
        yield from done()

    return run


def _across(members: DataFrame, families: DataFrame, marks: DataFrame, parts: int) -> DataFrame:
    """(a, b) of different families that share a bucket and whose sizes and estimates allow a link; enough of them to join
    all such families."""
    named = members.join(families, "id", "left").select("key", "id", F.coalesce("family", "id").alias("family"))
    several = named.groupBy("key").agg(F.min("family").alias("l"), F.max("family").alias("h"), F.ceil(F.count("*") / BLOCK).cast("int").alias("of")).filter("l != h").select("key", "of")
    rows = _paired(named.join(several, "key").join(marks.select("id", "n", "mark"), "id"), "key", ["family", "n", "mark"])
    dealt = rows.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def compare(group: list[tuple]) -> Iterator[tuple[int, int]]:
        i, j = group[0][1], group[0][2]
        side = np.array([r[3] == i for r in group])
        ids, family, n = [r[4] for r in group], np.unique([r[5] for r in group], return_inverse=True)[1], np.array([r[6] for r in group])
        marks = np.frombuffer(b"".join(r[7] for r in group), "<u8").reshape(len(group), -1)
        for p in range(len(group)):
            may = (family != family[p]) & (100 * np.minimum(n[p], n) >= PERCENT * np.maximum(n[p], n))
            may[: p + 1] = False
            if i != j:
                may &= side != side[p]
            at = np.flatnonzero(may)
            for q in at[estimates(marks[p], marks[at]) >= SURE] if len(at) else ():
                if family[q] != family[p]:
                    yield ids[p], ids[int(q)]
                    family[family == family[q]] = family[p]

    return dealt.mapInArrow(_by_group(compare), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Two texts are linked when 100 * intersection >= 80 * union of their sets of ``shingle``-word shingles (A-Z in lower
    case; a text of fewer words is one shingle). component_id is the smallest doc_id that links lead to; kept says that
    a row has it. Null texts and texts without words have no shingles, are linked with nothing and are kept. Repeated rows
    fall into one component and are kept or dropped alike; a null id never names a component of several ids, and kept is
    null where component_id is. ids are read as long. An empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    parts = parts_for(source, "text", PART_BYTES)
    rows = scratch.save(_sketched(source, shingle), "rows")
    once = rows.filter("mark is not null").groupBy("class").agg(*[F.first(c).alias(c) for c in ("n", "mark", "bands")])
    # From here on a class is a number.
    marks = scratch.save(once.withColumn("id", F.monotonically_increasing_id()), "marks")
    keyed = marks.select(F.explode("bands").alias("key"), "id")
    buckets = keyed.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).filter("pivot != last").select("key", "pivot")
    members = scratch.save(keyed.join(buckets, "key"), "members")
    stars = scratch.save(_similar(members.filter("id != pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct(), marks), "stars")
    families = lambda edges, name: components(edges, scratch, name).select(F.col("node").alias("id"), F.col("label").alias("family"))
    family = families(stars, "families")
    across = scratch.save(_across(members, family, marks, parts), "across")
    if across.head(1):
        family = families(stars.select("a", "b").unionByName(across), "families-all")
    wanted = marks.select("class", "id", "n", "mark").join(family, "id")
    texts = _texts_of(source, wanted, shingle, parts).groupBy("class").agg(F.min("text").alias("text"))
    grouped = scratch.save(texts.join(wanted, "class").select("family", "id", "n", "mark", "text"), "grouped")
    links = scratch.save(_links(grouped, parts, shingle), "links")
    labels = components(links, scratch, "labels")

    named = marks.select("class", "id").join(labels.withColumnRenamed("node", "id"), "id", "left").select("class", F.coalesce("label", "id").alias("label"))
    full = scratch.save(rows.filter("mark is null").select("doc_id", "n", "class").join(named, "class", "left").select("doc_id", "n", "label"), "full")
    low = scratch.save(full.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("low")), "low")
    scratch.keep_only("full", "low")
    component = F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("low"))
    out = full.join(low, "label", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
