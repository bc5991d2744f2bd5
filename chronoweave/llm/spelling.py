"""Spelling variants by a symmetric-delete join.

Every word emits itself and its single deletions. Words share such a key exactly if they may be near: a word that is
another one's deletion lacks one letter of it, and two words with the same rest after a deletion at the same place differ
in one letter there. The place is part of the second kind of key, so words of distance two, of which a frequent word
has many around it, do not meet. What meets is verified, then a word's form is aggregated from its near words, and
roots are found by joining forms to their own forms until nothing changes.

Scale: words are counted in each task first, in bounded tables. Keys are 63-bit hashes that follow from prefixes and
suffixes, and a row has a word's number instead of the word, so a word of a million letters emits a million short rows, not
a million long words. A key is shared by at most as many words as there are letters, for each place, so no key is hot.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import lower_ascii

LEAST_LETTERS, LEAST_COUNT, TIMES = 6, 5, 5
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Letters of the words that a task counts before it hands them on.
MOST_LETTERS = 4_000_000
#: Keys in a batch that a task emits.
MOST_KEYS = 100_000
_P, _B, _C = (1 << 61) - 1, 0x1F3D5B79A86420F, 0x9E3779B97F4A7C1


def runs(doc_id: object, text: str | None) -> Counter:
    """The text's maximal runs of letters in lower case (A-Z only), with their counts."""
    return Counter(_RUN.findall(lower_ascii(text))) if text else Counter()


def damaged(doc_id: object, text: str | None) -> Counter:
    """``runs``, of which those whose number (crc32 of `doc_id:run`) 199 divides lack one letter. A null id is empty there.
    What is left of one letter is no word."""
    out: Counter = Counter()
    head = f"{'' if doc_id is None else doc_id}:".encode()
    start = zlib.crc32(head)
    for word, n in runs(doc_id, text).items():
        h = zlib.crc32(word.encode(), start)
        if h % 199 == 0:
            word = word[: h % len(word)] + word[h % len(word) + 1 :]
        out[word] += n
    return out


def count_words(docs: DataFrame, doc_id: str, text: str, found: Callable[[object, str | None], Counter], letters: int) -> DataFrame:
    """(word, n) of the words of at least ``letters`` code points over all rows: counted in each task, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        held = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for i, t in zip(b.column(0), b.column(1)):
                for word, n in found(i.as_py(), t.as_py()).items():
                    if len(word) >= letters:
                        if word not in total:
                            held += len(word) + 8
                        total[word] += n
                if held > MOST_LETTERS:
                    yield out()
                    total.clear()
                    held = 0
        if total:
            yield out()

    return docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def keys(word: str) -> tuple[int, list[int]]:
    """The word's own key, and the keys of the word without its letter 0, 1, and so on."""
    codes = [ord(c) + 1 for c in word]
    suffix, power = [0], [1]
    for c in reversed(codes):
        suffix.append((c * power[-1] + suffix[-1]) % _P)
        power.append(power[-1] * _B % _P)
    n, prefix, out = len(codes), 0, []
    for i, c in enumerate(codes):
        out.append((prefix * power[n - 1 - i] + suffix[n - 1 - i]) % _P)
        prefix = (prefix * _B + c) % _P
    return prefix, out


def _emitted(words: DataFrame) -> DataFrame:
    """(id, key, place) for every word: place -1 for itself, -2 for each distinct deletion, and the place of a deletion
    (its key is of the place too)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found, places = [], [], []

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64()), pa.array(places, pa.int32())], ["id", "key", "place"])
            ids.clear(), found.clear(), places.clear()
            return b

        for b in batches:
            for i, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own, less = keys(w)
                for place, some in ((-1, [own]), (-2, list(set(less)))):
                    found += some
                    places += [place] * len(some)
                found += [(k + _C * (at + 1)) % _P for at, k in enumerate(less)]
                places += range(len(less))
                ids += [i] * (len(found) - len(ids))
                if len(ids) >= MOST_KEYS:
                    yield out()
        if ids:
            yield out()

    return words.select("id", "word").mapInArrow(run, "id long, key long, place int")


def near_pairs(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) both ways, for words (id, word) that differ by one inserted, deleted or replaced code point."""
    emitted = scratch.save(_emitted(words), "keys")
    own, less, at = emitted.filter("place = -1"), emitted.filter("place = -2"), emitted.filter("place >= 0")
    longer = own.select("key", F.col("id").alias("a")).join(less.select("key", F.col("id").alias("b")), "key").select("a", "b")
    other = at.select("key", "place", F.col("id").alias("a")).join(at.select("key", "place", F.col("id").alias("b")), ["key", "place"]).filter("a < b").select("a", "b")
    spelled = lambda c: words.select(F.col("id").alias(c), F.col("word").alias(f"{c}_word"))
    met = longer.unionByName(other).join(spelled("a"), "a").join(spelled("b"), "b")
    pairs = scratch.save(met.filter(F.levenshtein("a_word", "b_word", 1) == 1).select("a", "b").distinct(), "pairs")
    return pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def variants(words: DataFrame, times: int = TIMES, scratch: Scratch | None = None) -> DataFrame:
    """A row for each row of words (word, n; every word once): word, form, root, n, n_near, form_n.

    n_near is the number of words at a distance of exactly one. form is the most frequent of them (ties: the smallest in
    code-point order), if it occurs at least ``times`` times as often as the word; else null, as is form_n then. root is
    where following forms ends, the word itself without a form. Counts are positive, so forms never lead back.
    """
    scratch = scratch or Scratch(words.sparkSession, "spelling")
    table = scratch.save(words.select("word", "n", F.monotonically_increasing_id().alias("id")), "words")
    near = near_pairs(table, scratch)
    of = table.select(F.col("id").alias("b"), F.struct((-F.col("n")).alias("m"), "word", "id").alias("best"))
    best = near.join(of, "b").groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n_near"), F.min("best").alias("best"))
    fits = -F.col("best.m") >= times * F.col("n")
    formed = table.join(best, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.word")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n"), F.when(fits, F.col("best.id")).alias("up")
    )
    formed = scratch.save(formed, "formed")
    # Each round a word's way doubles; those whose way ends are left alone.
    roots, k = scratch.save(formed.filter("up is not null").select("id", F.col("up").alias("top")), "roots-0"), 0
    while True:
        step = roots.join(roots.select(F.col("id").alias("top"), F.col("top").alias("over")), "top", "left").select("id", F.coalesce("over", "top").alias("top"), F.col("over").isNotNull().alias("moved"))
        k += 1
        after = scratch.save(step, f"roots-{k}")
        scratch.drop(f"roots-{k - 1}")
        roots = after.select("id", "top")
        if not after.filter("moved").head(1):
            break
    scratch.keep_only("words", "formed", f"roots-{k}")
    named = table.select(F.col("id").alias("top"), F.col("word").alias("root"))
    return formed.join(roots, "id", "left").join(named, "top", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def document_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``variants`` of the words of all whole texts: of ``damaged`` runs, those of at least 6 code points that occur at
    least 5 times. Null and empty texts have no words; repeated rows count again; an empty table gives no rows; other
    columns are not read."""
    scratch = Scratch(docs.sparkSession, "spelling")
    return variants(count_words(docs, doc_id, text, damaged, LEAST_LETTERS).filter(F.col("n") >= LEAST_COUNT), TIMES, scratch)
