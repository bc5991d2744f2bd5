"""BPE encoding and decoding through a table of distinct words.

Spark splits all texts at white space. White space separates pre-tokens in this vocabulary, and its normaliser never
joins characters across it, so a text's ids are its words' ids in order of position.

1. Each batch of texts becomes positions (for each word of each text, its number among the batch's distinct words) and
   the batch's distinct words, dealt to parts by the hash of the word.
2. A part sorts out the distinct words of all batches and encodes each of them once with the tokenizers library. So
   every distinct word of the corpus is encoded once, in one part, at any size of the vocabulary. Each batch gets the
   ids of its words back.
3. Positions and ids meet in a join by batch, and each position takes the ids of its word. Decoding joins the ids with
   the id-to-piece table, which has as many rows as the vocabulary and is broadcast.

A word is sent once a batch, so one that makes up a third of all positions is no heavier than others. Texts are not
shuffled; positions are, at about one and a half bytes each, as the frequent words have small numbers. Texts are read
twice, once for positions and once for words, which spares a written copy of both.
"""

from __future__ import annotations

import functools
import hashlib
import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import parts_for, words

#: Characters of a batch, and bytes of text whose words a part takes.
BATCH_CHARS, PART_BYTES = 4_000_000, 16_000_000


@functools.lru_cache(1)
def _tokenizer(path: str):  # noqa: ANN202
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def id_to_piece(path: str) -> list[str]:
    t = _tokenizer(path)
    return [t.id_to_token(i) or "" for i in range(max(t.get_vocab(True).values()) + 1)]


def encode_words(path: str, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one after the other, number of ids of each)."""
    ids, n = [], []
    for i in range(0, len(distinct), 10_000):
        for e in _tokenizer(path).encode_batch_fast(distinct[i : i + 10_000], add_special_tokens=False):
            found = e.ids
            ids += found
            n.append(len(found))
    return np.array(ids, dtype="<u4"), np.array(n, dtype=np.int64)


def gather(flat: np.ndarray, n: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``which`` of ``flat``, whose runs have the lengths ``n``: (their values, their lengths)."""
    sizes = n[which]
    ends = np.cumsum(sizes)
    starts = (np.cumsum(n) - n)[which]
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes


def _squeeze(a: np.ndarray) -> bytes:
    """Numbers as zstandard of their byte planes, the low bytes first."""
    return zstandard.compress(a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _spread(data: bytes) -> np.ndarray:
    return np.frombuffer(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T.tobytes(), "<u4")


_SPLIT = "batch long, part int, doc_ids array<bigint>, sizes binary, numbers binary, words binary"
_NAMES = ["batch", "part", "doc_ids", "sizes", "numbers", "words"]
_KINDS = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())


def split_texts(docs: DataFrame, parts: int, positions: bool) -> DataFrame:
    """Of each batch of docs (doc_id, text): a row of positions (doc_ids; sizes: words of each text; numbers: of each
    word in the batch) or, for each part, a row of distinct words and their numbers. Both come from the same batches
    if ``docs`` gives the same rows in the same order each time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, ids, texts, size = TaskContext.get().partitionId() << 33, [], [], 0

        def out() -> pa.RecordBatch:
            # Frequent words come first, so that most numbers are small.
            found = [w for w, _ in Counter(w for t in texts for w in t).most_common()]
            if positions:
                number = {w: i for i, w in enumerate(found)}
                sizes = np.array([len(t) for t in texts])
                numbers = np.fromiter((number[w] for t in texts for w in t), np.int64, int(sizes.sum()))
                rows = [(batch, None, ids, _squeeze(sizes), _squeeze(numbers), None)]
            else:
                dealt: list[tuple[list[int], list[str]]] = [([], []) for _ in range(parts)]
                for i, w in enumerate(found):
                    at, held = dealt[zlib.crc32(w.encode()) % parts]
                    at.append(i)
                    held.append(w)
                rows = [(batch, p, None, None, _squeeze(np.array(at)), zstandard.compress(" ".join(held).encode())) for p, (at, held) in enumerate(dealt) if at]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, _KINDS)], _NAMES)

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py() or ""
                if ids and size + len(t) > BATCH_CHARS:
                    yield out()
                    batch, ids, texts, size = batch + 1, [], [], 0
                ids.append(i)
                texts.append(words(t))
                size += len(t)
        if ids:
            yield out()

    return docs.mapInArrow(run, _SPLIT)


def encode_parts(split: DataFrame, path: str) -> DataFrame:
    """(batch, numbers, n, ids): for each batch and part, the ids of its words. Each part encodes a word once."""

    def run(table: pa.Table) -> pa.Table:
        lists = [zstandard.decompress(x.as_py()).decode().split(" ") for x in table["words"]]
        index: dict[str, int] = {}
        which = [np.fromiter((index.setdefault(w, len(index)) for w in held), np.int64, len(held)) for held in lists]
        flat, n = encode_words(path, list(index))
        rows = [gather(flat, n, w) for w in which]
        return pa.table({"batch": table["batch"], "numbers": table["numbers"], "n": pa.array([_squeeze(r[1]) for r in rows], pa.binary()), "ids": pa.array([_squeeze(r[0]) for r in rows], pa.binary())})

    return split.select("batch", "part", "numbers", "words").groupBy("part").applyInArrow(run, "batch long, numbers binary, n binary, ids binary")


def encode_positions(docs: DataFrame, path: str, result, schema: str, scratch: Scratch, doc_id: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: ANN001
    """``result`` (doc_ids, ids of all texts one after the other, ids of each text) -> table, of every batch."""
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        source = scratch.save(source, "source")  # after a shuffle, rows may come in another order the second time
    parts = parts_for(source, "text", PART_BYTES)
    positions = split_texts(source, parts, True).select("batch", "doc_ids", "sizes", "numbers", F.lit(None).cast("binary").alias("ids"))
    encoded = encode_parts(split_texts(source, parts, False), path).select("batch", F.lit(None).cast("array<bigint>").alias("doc_ids"), F.col("n").alias("sizes"), "numbers", "ids")

    def run(table: pa.Table) -> pa.Table:
        own, places, lengths, ids = None, [], [], []
        for r in table.select(["doc_ids", "sizes", "numbers", "ids"]).to_pylist():
            if r["ids"] is None:
                own = r
            else:
                places.append(_spread(r["numbers"]))
                lengths.append(_spread(r["sizes"]))
                ids.append(_spread(r["ids"]))
        sizes, numbers = _spread(own["sizes"]).astype(np.int64), _spread(own["numbers"])
        if sum(map(len, places)) != (int(numbers.max()) + 1 if len(numbers) else 0):
            raise RuntimeError("the rows came in another order when they were read again")
        if not places:
            return result(own["doc_ids"], np.zeros(0, "<u4"), np.zeros(len(sizes), np.int64))
        # Word k of the batch is run number[k] of what the parts sent.
        number = np.argsort(np.concatenate(places), kind="stable")
        flat, n = gather(np.concatenate(ids), np.concatenate(lengths).astype(np.int64), number[numbers])
        before = np.concatenate([[0], np.cumsum(n)])
        ends = np.cumsum(sizes)
        return result(own["doc_ids"], flat, before[ends] - before[ends - sizes])

    return positions.unionByName(encoded).groupBy("batch").applyInArrow(run, schema)


def encode_decode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row's whole text.

    A null or empty text has no tokens and decodes to the empty text. Repeated rows give repeated rows; null
    ids stay; ids are read as long; an empty table gives no rows; other columns are not read. ``path`` names the
    vocabulary file on every machine.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(id_to_piece(path))

    def digests(doc_ids: list, ids: np.ndarray, n: np.ndarray) -> pa.Table:
        end = np.cumsum(n)
        data = ids.astype("<u4").tobytes()
        held = pa.array(pieces.value, pa.string())
        decoded = []
        for i in range(0, len(n), 256):  # some texts at a time: pieces are longer than ids
            first, last = (end[i] - n[i], end[min(i + 256, len(n)) - 1]) if len(n) else (0, 0)
            joined = pa.LargeListArray.from_arrays(np.concatenate([[0], end[i : i + 256] - first]), held.take(pa.array(ids[first:last])).cast(pa.large_string()))
            decoded += [hashlib.sha256(x.as_py().encode()).hexdigest() for x in pc.binary_join(joined, pa.scalar(" ", pa.large_string()))]
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": n, "ids_sha256": [hashlib.sha256(data[4 * (e - k) : 4 * e]).hexdigest() for e, k in zip(end.tolist(), n.tolist())], "decoded_sha256": decoded})

    return encode_positions(docs, path, digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", Scratch(docs.sparkSession, "bpe"), doc_id, text)


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) of every row's whole text, in the same way."""

    def lists(doc_ids: list, ids: np.ndarray, n: np.ndarray) -> pa.Table:
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), pa.array(ids.astype(np.int32)))})

    return encode_positions(docs, path, lists, "doc_id long, ids array<int>", Scratch(docs.sparkSession, "bpe"), doc_id, text)


def decode(encoded: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the text that a column of ids stands for: every id meets its piece in a join with the
    id-to-piece table, and a row's pieces come together in order of position. Null ids are the empty text."""
    spark, scratch = encoded.sparkSession, Scratch(encoded.sparkSession, "decode")
    rows = scratch.save(encoded.select(F.monotonically_increasing_id().alias("_row"), F.struct(*[F.col(f"`{c}`") for c in encoded.columns]).alias("_kept")), "rows")
    # As many rows as the vocabulary has ids.
    pieces = F.broadcast(spark.createDataFrame(list(enumerate(id_to_piece(path))), "id int, piece string"))
    found = rows.select("_row", F.posexplode(F.col(f"_kept.`{ids}`")).alias("pos", "id")).join(pieces, "id").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("_found"))
    return rows.join(found, "_row", "left").select("_kept.*", F.coalesce(F.array_join(F.col("_found.piece"), " "), F.lit("")).alias(into))
