"""Packing by concatenate and cut.

First pass: each task encodes its documents, writes the ids with their offset in its own part, and so gives a
total per part. A prefix sum over the parts' totals (one row a task) makes those offsets global. Second pass:
fixed windows over the global offsets cut each document where a window ends; a document over a border has a
record in each window. Only part totals meet in one place; ids are written once and never shuffled.
"""

from __future__ import annotations

import contextlib
import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: How the library's ByteLevel pre-tokenizer cuts a text (a fixed value of the format; files name it, not spell it).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """The format writes a printable byte as its own Latin-1 character and the others, in order, from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(own)))}


class ByteEncoder:
    """Ids of whole texts under a byte-level BPE vocabulary file of the tokenizers library.

    Ids in such a file are in order of merges, so they serve as ranks, and tiktoken gives the library's ids at a
    quarter of the time. The library itself encodes every text where the file asks for more than plain byte-level
    BPE, and texts that tiktoken refuses (its pattern runs out of stack on some 10^6 spaces in a row). The names
    of special tokens in a text are those tokens, as the library has it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.special, self.encoding = list(special), None
        before = file.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not file.get("normalizer")
        model = file["model"]
        if plain and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            byte = _byte_of()
            ranks = {bytes(byte[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in special}
            self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        if self.encoding is not None:
            with contextlib.suppress(ValueError):
                if any(s in text for s in self.special):
                    return np.array(self.encoding.encode(text, allowed_special="all"), dtype="<u4")
                return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")


@functools.lru_cache(1)
def _encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def encode_parts(docs: DataFrame, path: str, end_id: int, doc_id: str, text: str) -> DataFrame:
    """First pass: part, at (ids before it in its part), doc_id, n and ids (little-endian unsigned 32-bit)."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = _encoder(path), TaskContext.get().partitionId(), 0
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                b = whole.slice(start, 500)
                ids = [encoder.encode(t.as_py() or "").tobytes() + end for t in b.column(1)]
                n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                before = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), pa.array(before), b.column(0), pa.array(n), pa.array(ids, pa.binary())], ["part", "at", "doc_id", "n", "ids"])

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "part int, at long, doc_id long, n long, ids binary")


def pack(docs: DataFrame, path: str, length: int = 1024, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length, ids.

    Every document's ids, then ``end_id``, follow each other; every ``length`` ids make a sequence. All
    sequences but the last are full; the last is padded to ``length`` unless its own length is a power of two
    (padded_length says so). A null or empty text is the end id alone. Repeated rows and null ids are packed
    like others; an empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    parts = scratch.save(encode_parts(docs, path, end_id, doc_id, text), "parts")
    totals = parts.groupBy("part").agg(F.sum("n").alias("total"))
    # One row a task: small, though it grows with the number of tasks, so Spark decides whether to broadcast it.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch.save(totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"), F.sum("total").over(Window.partitionBy()).alias("all")), "offsets")
    first = F.col("base") + F.col("at")
    windows = F.sequence(F.expr(f"(base + at) div {length}"), F.expr(f"(base + at + n - 1) div {length}"))
    pieces = (
        parts.join(offsets, "part")
        .select("doc_id", "n", "ids", first.alias("first"), "all", F.explode(windows).alias("sequence_id"))
        .withColumn("begin", F.greatest("first", F.col("sequence_id") * length))
        .withColumn("end", F.least(F.col("first") + F.col("n"), (F.col("sequence_id") + 1) * length))
        .withColumn("size", F.least(F.lit(length), F.col("all") - F.col("sequence_id") * length))
        .withColumn("piece", F.expr("substring(ids, cast((begin - first) * 4 + 1 as int), cast((end - begin) * 4 as int))"))
    )
    return pieces.select(
        "doc_id",
        (F.col("begin") - F.col("first")).alias("start"),
        (F.col("end") - F.col("begin")).alias("length"),
        F.crc32("piece").alias("ids_crc32"),
        F.col("n").alias("doc_tokens"),
        "sequence_id",
        (F.col("begin") - F.col("sequence_id") * length).alias("offset"),
        F.when(F.col("size").bitwiseAND(F.col("size") - 1) == 0, F.col("size")).otherwise(F.lit(length).cast("long")).alias("padded_length"),
        F.col("piece").alias("ids"),
    )
