"""Repeated passages by a sparse suffix array.

Suffixes are retained at minimisers only: among any 26 neighbouring runs of 25 words, the one whose hash is
least. Its place depends on the words alone, so two copies of a passage of 50 words retain the same suffixes, and
every run of 50 words has one retained suffix in it.

1. The retained suffixes' first 25 words are sorted (by hash) and neighbours compared. Suffixes without an equal
   neighbour go; an exact join by row says each text which of its suffixes stay.
2. Those that stay are sorted by their words, and each is compared with its neighbour in that order: how many words
   they have in common from the suffix on. They are sorted by the words before them, from right to left, and
   compared in the same way. So each match is extended to the right and to the left, word by word, as far as a run
   of 50 words needs: the suffixes that agree in a words before and 50 - a words from the suffix on are those
   between two short common lengths in both orders, and a run of 50 words around a suffix is repeated if another
   suffix agrees so.
3. A document's overlapping repeated runs merge into passages as long as they go.

The result is exactly the words that lie in some run of 50 words found twice or more (words are compared by 48 bits of
their hash, and a run has 50). Suffixes with the same 25 words before and 50 from it on are repeated wherever they
stand: a task sends the first two and says of others at once that they are later ones, so a passage that a third of
all documents hold sends two rows for each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import _WORD, Hashes, mix, parts_for, words

#: Words of a repeated passage at least; words of a suffix that are compared first.
PASSAGE, LEAD = 50, 25
#: Words before a suffix that a run around it may have.
BEFORE = PASSAGE - LEAD
#: Bytes of text whose suffixes a part compares, characters of a batch, and keys that a task remembers.
PART_BYTES, CHARS, REMEMBERED = 16_000_000, 1_000_000, 300_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Runs:
    """Hashes of all n-word runs of a text from prefix sums, whatever n."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * self.up[-1] * _STEP])
            self.down = np.concatenate([self.down, self.down * self.down[-1] * _BACK])
            assert len(self.up) == 2 * k

    def sums(self, h: np.ndarray) -> np.ndarray:
        self._powers(len(h) + 1)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * self.up[: len(h)], dtype=np.uint64)])

    def hashes(self, sums: np.ndarray, n: int) -> np.ndarray:
        """Positive 63-bit hashes; equal runs have equal ones wherever they stand."""
        got = (sums[n:] - sums[:-n]) * self.down[: len(sums) - n]
        return (mix(got) >> np.uint64(1)).astype(np.int64)


def minimisers(lead: np.ndarray, passage: int, size: int) -> np.ndarray:
    """For each run of ``passage`` words, the position of its least run of ``size`` words (the first of equals)."""
    w = passage - size + 1
    return np.lib.stride_tricks.sliding_window_view(lead, w).argmin(axis=1) + np.arange(len(lead) - w + 1)


def _by_part(parts: int, key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(key % parts, kind="stable")
    cut = np.searchsorted((key % parts)[order], np.arange(parts + 1))
    for p in range(parts):
        if cut[p] < cut[p + 1]:
            yield p, order[cut[p] : cut[p + 1]]


def _batches(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of some CHARS characters; a longer text stands alone."""
    start, size = 0, 0
    for i, t in enumerate(b.column(column)):
        n = len(t.as_py() or "")
        if i > start and size + n > CHARS:
            yield b.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < b.num_rows:
        yield b.slice(start)


_POINTS = "part int, rows binary, keys binary"


def _leads(docs: DataFrame, parts: int) -> DataFrame:
    """Hashes of the first 25 words of all retained suffixes and their rows: to the part that compares them (>= 0), or,
    where the task has sent a key twice already, to the row's part (below 0) as one that is known to be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, runs, sent = Hashes(), Runs(), {}
        for b in (x for whole in batches for x in _batches(whole, 1)):
            keys, rows = [], []
            for row, t in zip(b.column(0).to_pylist(), b.column(1)):
                w = words(t.as_py() or "")
                if len(w) >= PASSAGE:
                    lead = runs.hashes(runs.sums(hashes.of(w)), LEAD)
                    keys.append(lead[np.unique(minimisers(lead, PASSAGE, LEAD))])
                    rows.append(np.full(len(keys[-1]), row, np.int64))
            if not keys:
                continue
            keys, rows = np.concatenate(keys), np.concatenate(rows)
            known = np.zeros(len(keys), bool)
            if len(sent) > REMEMBERED:
                sent.clear()
            for i, k in enumerate(keys.tolist()):
                n = sent.get(k, 0)
                if n < 2:
                    sent[k] = n + 1
                else:
                    known[i] = True
            out = []
            for mask, by, name in ((~known, keys, lambda p: p), (known, rows, lambda p: -1 - p)):
                at = np.flatnonzero(mask)
                out += [(name(p), rows[at[x]].tobytes(), keys[at[x]].tobytes()) for p, x in _by_part(parts, by[at])]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary()))], ["part", "rows", "keys"])

    return docs.select("row", "text").mapInArrow(run, _POINTS)


def _column(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_py(), kind) for x in table[name]])


def _equal_leads(table: pa.Table) -> pa.Table:
    """(row, keys): of each row those keys that stand somewhere else too."""
    rows, keys = _column(table, "rows", np.int64), _column(table, "keys", np.int64)
    if table["part"][0].as_py() >= 0:
        order = np.argsort(keys, kind="stable")
        rows, keys = rows[order], keys[order]
        same = keys[1:] == keys[:-1]
        stay = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        rows, keys = rows[stay], keys[stay]
    order = np.argsort(rows, kind="stable")
    rows, keys = rows[order], keys[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, np.int64)
    return pa.table({"row": rows[first], "keys": pa.array([k.tobytes() for k in np.split(keys, first[1:])] if len(first) else [], pa.binary())})


_SUFFIXES = "part int, rows binary, ids binary, places binary, least binary, most binary, around binary"
_MARKS = "part int, rows binary, ids binary, places binary, found binary, later binary"
_NULL_ID = np.iinfo(np.int64).max  # after all others
_ODD = mix(np.arange(1, BEFORE + PASSAGE + 2, dtype=np.uint64)) | np.uint64(1)


def _masks(least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Bits least to most."""
    return ((np.uint64(2) << most.astype(np.uint64)) - (np.uint64(1) << least.astype(np.uint64))).astype(np.uint32)


def _suffixes(docs: DataFrame, parts: int) -> DataFrame:
    """The suffixes that stay, to the part of their first words (>= 0): places; least and most words before them that
    a run of theirs has; the words around them. Those that are known to be later ones go to their row's part (below
    0), with the runs of theirs as marks in least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, runs, sent = Hashes(), Runs(), {}
        span = np.arange(-BEFORE, PASSAGE)
        for b in (x for whole in batches for x in _batches(whole, 2)):
            found = []
            for row, i, t, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()):
                h = hashes.of(words(t.as_py() or ""))
                lead = runs.hashes(runs.sums(h), LEAD)
                m = minimisers(lead, PASSAGE, LEAD)
                at, first, n = np.unique(m, return_index=True, return_counts=True)  # runs of one suffix follow each other
                stay = np.isin(lead[at], np.frombuffer(b"".join(held), np.int64))
                at, first, n = at[stay], first[stay], n[stay]
                padded = np.concatenate([np.zeros(BEFORE, np.uint64), h >> np.uint64(16), np.zeros(PASSAGE, np.uint64)])
                found.append((np.full(len(at), row, np.int64), np.full(len(at), _NULL_ID if i is None else i, np.int64), at, at - first - n + 1, at - first, lead[at], padded[at[:, None] + BEFORE + span]))
            if not found:
                continue
            rows, ids, places, least, most, lead, around = (np.concatenate(x) for x in zip(*found))
            prints = mix((around * _ODD[:-1]).sum(axis=1, dtype=np.uint64) + (least * 64 + most).astype(np.uint64) * _ODD[-1])
            known = np.zeros(len(rows), bool)
            if len(sent) > REMEMBERED:
                sent.clear()
            for k, (p, place) in enumerate(zip(prints.tolist(), zip(ids.tolist(), rows.tolist(), places.tolist()))):
                n, best = sent.get(p, (0, place))
                if n >= 2 and place > best:
                    known[k] = True
                else:
                    sent[p] = n + 1, min(best, place)
            out = []
            at = np.flatnonzero(~known)
            for p, x in _by_part(parts, lead[at]):
                x = at[x]
                out.append((p, rows[x].tobytes(), ids[x].tobytes(), places[x].tobytes(), least[x].astype(np.uint8).tobytes(), most[x].astype(np.uint8).tobytes(), around[x].view(np.uint8).reshape(-1, 8)[:, :6].tobytes()))
            at = np.flatnonzero(known)
            for p, x in _by_part(parts, rows[at]):
                x = at[x]
                out.append((-1 - p, rows[x].tobytes(), ids[x].tobytes(), places[x].tobytes(), _masks(least[x], most[x]).tobytes(), b"", b""))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), *[pa.binary()] * 6))], ["part", "rows", "ids", "places", "least", "most", "around"])

    return docs.select("row", "doc_id", "text", "held").mapInArrow(run, _SUFFIXES)


def common_lengths(words_of: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For rows in an order, the number of leading columns that each has in common with the row before it."""
    differ = words_of[order[1:]] != words_of[order[:-1]]
    n = np.where(differ.any(axis=1), differ.argmax(axis=1), words_of.shape[1])
    return np.concatenate([[0], n])


def _classes(order: np.ndarray, common: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the rows' classes of equal first n columns, by row."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < n)
    return out


def repeated_runs(around: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes in order of place, whose words around them are ``around``: bits a for the runs of 50 words with a
    words before the suffix that another suffix has too, and that an earlier one has."""
    right, left = around[:, BEFORE:], around[:, :BEFORE][:, ::-1]
    by_right, by_left = np.lexsort(right.T[::-1]), np.lexsort(left.T[::-1])
    common_right, common_left = common_lengths(right, by_right), common_lengths(left, by_left)
    found, later = np.zeros(len(around), np.uint32), np.zeros(len(around), np.uint32)
    for a in range(BEFORE + 1):
        has = np.flatnonzero((least <= a) & (a <= most))
        if len(has) < 2:
            continue
        key = _classes(by_right, common_right, PASSAGE - a)[has] * (len(around) + 1) + (_classes(by_left, common_left, a)[has] if a else 0)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.concatenate([[False], same])
        later[has[order[again]]] |= np.uint32(1 << a)
        found[has[order[again | np.concatenate([same, [False]])]]] |= np.uint32(1 << a)
    return found, later


def _compare(parts: int):  # noqa: ANN202
    """Sort a part's suffixes, compare neighbours, and send the marks of those with repeated runs to their row's part."""

    def run(table: pa.Table) -> pa.Table:
        if table["part"][0].as_py() < 0:
            return pa.Table.from_arrays([pa.array([-1 - x for x in table["part"].to_pylist()], pa.int32()), table["rows"], table["ids"], table["places"], table["least"], table["least"]], names=["part", "rows", "ids", "places", "found", "later"])
        rows, ids, places, least, most = (_column(table, n, k) for n, k in (("rows", np.int64), ("ids", np.int64), ("places", np.int64), ("least", np.uint8), ("most", np.uint8)))
        packed = _column(table, "around", np.uint8).reshape(-1, 6)
        around = np.zeros((len(packed), 8), np.uint8)
        around[:, :6] = packed
        order = np.lexsort((places, rows, ids))
        rows, ids, places, around = rows[order], ids[order], places[order], around.view(np.uint64).reshape(len(rows), -1)[order]
        found, later = repeated_runs(around, least[order], most[order])
        at = np.flatnonzero(found)
        out = [(p, *(c[at[x]].tobytes() for c in (rows, ids, places, found, later))) for p, x in _by_part(parts, rows[at])]
        cols = list(zip(*out)) if out else [()] * 6
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), *[pa.binary()] * 5))], names=["part", "rows", "ids", "places", "found", "later"])

    return run


def _merge(rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the runs that begin at ``starts``: (row, start, end) of each passage. Sorted by row and start."""
    if not len(rows):
        return rows, starts, starts
    new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (starts[1:] > starts[:-1] + PASSAGE)])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(rows) - 1]])
    return rows[new], starts[new], starts[last] + PASSAGE


def _passages(table: pa.Table) -> pa.Table:
    rows, ids, places, found, later = (_column(table, n, k) for n, k in (("rows", np.int64), ("ids", np.int64), ("places", np.int64), ("found", np.uint32), ("later", np.uint32)))
    every, first = np.unique(rows, return_index=True)
    out = []
    for kind, bits in ((False, found), (True, later)):
        marked = [np.flatnonzero(bits >> np.uint32(a) & np.uint32(1)) for a in range(BEFORE + 1)]
        r = np.concatenate([rows[m] for m in marked])
        starts = np.concatenate([places[m] - a for a, m in enumerate(marked)])
        order = np.lexsort((starts, r))
        r, a, z = _merge(r[order], starts[order])
        out.append(pa.table({"row": r, "doc_id": ids[first[np.searchsorted(every, r)]], "start_word": a, "n_words": z - a, "later": np.full(len(r), kind)}))
    return pa.concat_tables(out)


def _found(source: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, doc_id, start_word, n_words, later) of a written table (row, doc_id, text)."""
    parts = parts_for(source, "text", PART_BYTES)
    stay = _leads(source, parts).groupBy("part").applyInArrow(_equal_leads, "row long, keys binary")
    held = scratch.save(stay.groupBy("row").agg(F.collect_list("keys").alias("held")), "leads")
    # One strategy at every size: both sides grow with the input.
    texts = source.join(held.hint("merge"), "row")
    marks = _suffixes(texts, parts).groupBy("part").applyInArrow(_compare(parts), _MARKS)
    found = marks.groupBy("part").applyInArrow(_passages, "row long, doc_id long, start_word long, n_words long, later boolean")
    out = scratch.save(found.withColumn("doc_id", F.when(F.col("doc_id") != _NULL_ID, F.col("doc_id"))), "passages")
    scratch.drop("leads")
    return out


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per passage: doc_id, start_word (from 0), n_words, n_later.

    A passage is a longest stretch of words each of which lies in some run of 50 words that stands at two places
    or more, of one document or several. n_later counts those of its words that repeat an earlier place (places
    are in order of doc_id, null ids last, then of rows, then of position). Words are runs without ASCII white
    space, compared as they are. Texts that are null, empty or of fewer than 50 words have no passages; repeated
    rows repeat all of theirs; ids are read as long; an empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "suffixes")
    source = scratch.save(docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")), "rows")
    found = _found(source, scratch)
    scratch.drop("rows")
    whole = found.filter("not later").select("row", "doc_id", "start_word", "n_words")
    later = found.filter("later").select("row", F.col("start_word").alias("s"), F.col("n_words").alias("k"))
    # A document's later passages lie inside its passages; long lists stay rows, joined by row.
    inside = later.join(whole.select("row", "start_word", "n_words"), "row").filter("s >= start_word and s < start_word + n_words").groupBy("row", "start_word").agg(F.sum("k").alias("n_later"))
    return whole.join(inside, ["row", "start_word"], "left").select("doc_id", "start_word", "n_words", F.coalesce("n_later", F.lit(0)).alias("n_later"))


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of ``spans`` (first, number) and the white space after them."""
    at = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    out, done = [], 0
    for start, n in sorted(spans):
        out.append(text[done : at[start]])
        done = at[start + n]
    return "".join([*out, text[done:]])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with each repeated passage left at its first place only. Rows that lose all their words go (rows without
    words stay as they are); all
    others keep their columns, with the text shortened where it repeats."""
    scratch = Scratch(docs.sparkSession, "repeats")
    kept = scratch.save(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_kept")), "rows")
    source = kept.select(F.col(f"_kept.`{doc_id}`").cast("long").alias("doc_id"), F.col(f"_kept.`{text}`").alias("text"), F.col("_row").alias("row"))
    later = _found(source, scratch).filter("later").groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("start_word", "n_words")).alias("_spans"))

    @F.pandas_udf("string")
    def cut(t, s):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([cut_words(x or "", [(int(r["start_word"]), int(r["n_words"])) for r in y]) for x, y in zip(t, s)])

    joined = kept.join(later.hint("merge"), "_row", "left")  # one strategy at every size
    same = joined.filter("_spans is null").select("_kept.*")
    shortened = joined.filter("_spans is not null").withColumn("_text", cut(F.col(f"_kept.`{text}`"), F.col("_spans"))).filter(F.col("_text").rlike(r"[^\x20\x09-\x0D]"))
    return same.unionByName(shortened.select(*[F.col("_text").alias(text) if c == text else F.col(f"_kept.`{c}`") for c in docs.columns]))
