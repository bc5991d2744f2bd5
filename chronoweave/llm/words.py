"""Words of whole texts, their 64-bit hashes and their counts over all documents."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Python's split() also cuts at these; a word in the sense used here may hold them.
_NOT_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text: str) -> list[str]:
    """Runs without ASCII white space (20, 09 to 0D), and of nothing else."""
    return _WORD.findall(text) if _NOT_SPACE.search(text) else text.split()


def lower_ascii(text: str) -> str:
    """A-Z in lower case, nothing else changed."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


class Hashes(dict):
    """word -> 64-bit hash, remembered for the words met so far; forgotten beyond a bound."""

    MOST = 250_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word runs, in order; word order counts."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(len(h) - n + 1, 0x9E3779B97F4A7C15, dtype=np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0x100000001B3) + h[i : len(h) - n + 1 + i])
    return out


def parts_for(docs: DataFrame, text: str, size: int) -> int:
    """Parts of about ``size`` bytes of text each: from the input's size, and no fewer than the session's partitions."""
    found = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    return max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-found // size))


def count_words(docs: DataFrame, text: str, split: Callable[[str], list[str]], flush: int = 300_000) -> DataFrame:
    """(word, n) over all rows: counted in each task first, then summed by word. A task holds ``flush`` words at most."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for t in b.column(0):
                found.update(split(t.as_py() or ""))
                if len(found) > flush:
                    yield out()
                    found.clear()
        if found:
            yield out()

    return docs.select(F.col(f"`{text}`")).mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_of(counts: DataFrame, most: int, longest: int = 64) -> DataFrame:
    """The most frequent words: ``most`` of them at most, each of ``longest`` bytes at most, so its size is
    bounded whatever the corpus. The cut is a count, found from a histogram; words at the cut stay out."""
    short = counts.filter(F.octet_length("word") <= longest)
    steps = short.groupBy(F.floor(F.log2("n") * 16).alias("step")).agg(F.count("*").alias("k"), F.min("n").alias("low")).collect()
    total, low = 0, None
    for r in sorted(steps, key=lambda r: -r["step"]):
        total += r["k"]
        if total > most:
            break
        low = r["low"]
    return short.filter(F.col("n") >= low) if low is not None else short.limit(0)
