"""Language identification with language-bitmask n-gram filters.

Training counts hashed n-grams per language over all labelled rows. Each language keeps its telling n-grams in a
Bloom filter: all those whose rate in it is at least SHARE of the highest rate in any language. The filters are
bit-sliced, so one slot holds one bit of every language, and the AND of an n-gram's slots is the set of all
languages that hold it. A text's popcounts per language, each corrected for its filter's false positives, decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import mix

#: Length of an n-gram in bytes of lower-cased UTF-8.
N = 4
#: Probes for an n-gram. Slots: a power of two, eight for each n-gram of the largest language or more, between these
#: bounds (there are 2^32 n-grams of four bytes; beyond the upper bound, 64 MB for eight languages, all n-grams are still
#: in the filters, which let more through by chance, and the corrected popcounts know how much).
PROBES = 2
LEAST_SLOTS, MOST_SLOTS = 1 << 19, 1 << 26
#: A language holds an n-gram if its rate there is at least this share of the highest rate of any language.
SHARE = 0.5
#: ASCII other than letters counts as one kind of gap.
_GAPS = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def gram_codes(text: str) -> np.ndarray:
    """32-bit codes of the text's n-grams, one for each byte position; the text has a gap at both ends."""
    data = b" " + text.lower().encode("utf-8", "surrogatepass").translate(_GAPS) + b" "
    a = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    return a[:-3] << np.uint32(24) | a[1:-2] << np.uint32(16) | a[2:-1] << np.uint32(8) | a[3:] if len(a) >= N else np.zeros(0, np.uint32)


def gram_counts(labelled: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n) over all labelled rows: counted in each task, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        parts: dict[str, list[np.ndarray]] = {}
        held = 0

        def fold() -> None:
            for k, v in parts.items():
                codes, n = np.unique(np.concatenate(v), return_counts=True)
                if k in total:
                    c, i = np.unique(np.concatenate([total[k][0], codes]), return_inverse=True)
                    total[k] = c, np.bincount(i, np.concatenate([total[k][1], n])).astype(np.int64)
                else:
                    total[k] = codes, n
            parts.clear()

        for b in batches:
            for t, k in zip(b.column(0), b.column(1).to_pylist()):
                codes = gram_codes(t.as_py() or "")
                parts.setdefault(k, []).append(codes)
                held += len(codes)
                if held > 4_000_000:
                    fold()
                    held = 0
        fold()
        for k, (codes, n) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    return labelled.select(F.col(f"`{text}`"), F.col(f"`{lang}`")).mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def slots(codes: np.ndarray, size: int) -> list[np.ndarray]:
    h = mix(codes.astype(np.uint64) + np.uint64(0x51ED270B))
    return [(h >> np.uint64(32 * i)).astype(np.uint32) & np.uint32(size - 1) for i in range(PROBES)]


def _width(langs: int) -> type:
    """The least number type with a bit for each language; planes of 64 beyond that."""
    return next((t for t in (np.uint8, np.uint16, np.uint32) if langs <= np.dtype(t).itemsize * 8), np.uint64)


@dataclass
class Filters:
    """planes[p][slot]: bits of languages 64 p to 64 p + 63."""

    langs: list[str]
    planes: list[np.ndarray]
    false_rate: np.ndarray

    @classmethod
    def of(cls, langs: list[str], planes: list[np.ndarray]) -> Filters:
        fill = np.array([np.count_nonzero(planes[k // 64] >> planes[0].dtype.type(k % 64) & planes[0].dtype.type(1)) / len(planes[0]) for k in range(len(langs))])
        return cls(langs, planes, fill**PROBES)

    @classmethod
    def build(cls, langs: list[str], grams: dict[str, np.ndarray], size: int) -> Filters:
        kind = _width(len(langs))
        planes = [np.zeros(size, kind) for _ in range(-(-len(langs) // 64))]
        for k, lang in enumerate(langs):
            for s in slots(grams[lang], size):
                planes[k // 64][s] |= kind(1 << k % 64)
        return cls.of(langs, planes)

    def hits(self, codes: np.ndarray) -> np.ndarray:
        """n-grams of the text that each language's filter says it contains."""
        where = slots(codes, len(self.planes[0]))
        out = np.zeros(len(self.langs))
        for p, plane in enumerate(self.planes):
            got = plane[where[0]]
            for s in where[1:]:
                got &= plane[s]
            for k in range(64 * p, min(64 * p + 64, len(self.langs))):
                out[k] = np.count_nonzero(got & got.dtype.type(1 << k % 64))
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language whose corrected count is highest (the first of equals) and its share of all of them. Without
        any hit, as for a text of one letter, that is the language with most n-grams, with score 0."""
        if not self.langs or not has_letter(text):
            return "und", 0.0
        codes = gram_codes(text)
        n = len(codes)
        true = np.clip((self.hits(codes) - n * self.false_rate) / (1 - self.false_rate), 0, None)
        best = int(np.argmax(true))
        total = float(true.sum())
        return self.langs[best], float(true[best] / total) if total else 0.0


_SEGMENT = 1 << 16


def _filled(telling: DataFrame, langs: list[str], size: int) -> list[np.ndarray]:
    """The planes of rows (k, gram), k the number of a language: each task fills segments of slots, which are then put
    together. What comes to the driver is the filters, whose size has a bound."""
    kind = _width(len(langs))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, codes = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.uint32)
            at = np.concatenate(slots(codes, size)).astype(np.int64)
            keys, which = np.unique(np.tile(k // 64, PROBES) * size + at, return_inverse=True)
            bits = np.zeros(len(keys), np.uint64)
            np.bitwise_or.at(bits, which, np.tile(np.uint64(1) << (k % 64).astype(np.uint64), PROBES))
            yield pa.RecordBatch.from_arrays([pa.array(keys // _SEGMENT), pa.array(keys % _SEGMENT), pa.array(bits.view(np.int64))], ["segment", "at", "bits"])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, np.ndarray] = {}
        for b in batches:
            segment, at, bits = (c.to_numpy() for c in b.columns)
            for s in np.unique(segment).tolist():
                mine = segment == s
                np.bitwise_or.at(got.setdefault(s, np.zeros(_SEGMENT, kind)), at[mine], bits[mine].view(np.uint64).astype(kind))
        for s, x in got.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([zstandard.compress(x.tobytes())], pa.binary())], ["segment", "data"])

    out = np.zeros((-(-len(langs) // 64) * size // _SEGMENT, _SEGMENT), kind)
    for r in telling.select("k", "gram").mapInArrow(placed, "segment long, at long, bits long").repartition("segment").mapInArrow(put, "segment long, data binary").collect():
        out[r["segment"]] |= np.frombuffer(zstandard.decompress(r["data"]), kind)
    return list(out.reshape(-1, size))


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Filters:
    """Filters from all rows with a language, with all of each language's telling n-grams, in the same few jobs
    whatever the number of languages. Of the rows only counts by n-gram are shuffled."""
    scratch = Scratch(labelled.sparkSession, "grams")
    counts = scratch.save(gram_counts(labelled.filter(F.col(f"`{lang}`").isNotNull()), text, lang), "counts")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    # Ties in total go by name, so that the order is the same at each run.
    langs = sorted(totals, key=lambda k: (-totals[k], k))
    if not langs:
        return Filters([], [], np.zeros(0))
    of = F.create_map(*[F.lit(x) for i, k in enumerate(langs) for x in (k, F.struct(F.lit(i).cast("long").alias("k"), F.lit(float(totals[k])).alias("n")))])
    rated = counts.withColumn("of", F.element_at(of, F.col("lang"))).select("gram", F.struct((F.col("n") / F.col("of.n")).alias("rate"), F.col("of.k").alias("k")).alias("x"))
    # An n-gram has one entry for each language at most.
    held = rated.groupBy("gram").agg(F.collect_list("x").alias("xs")).select("gram", F.explode(F.filter("xs", lambda x: x["rate"] >= SHARE * F.array_max(F.col("xs.rate")))).alias("x"))
    telling = scratch.save(held.select(F.col("x.k").alias("k"), "gram"), "telling")
    most = telling.groupBy("k").count().agg(F.max("count")).first()[0]
    size = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (8 * most - 1).bit_length()))
    filters = Filters.of(langs, _filled(telling, langs, size))
    scratch.drop("counts", "telling")
    return filters


def identify(docs: DataFrame, filters: Filters, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) for every row; ``und`` and 0 for null texts, texts without a letter,
    and where nothing was learnt. Repeated rows and null ids stay; ids are read as long; other
    columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shared.value.predict(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
