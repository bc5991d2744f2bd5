"""A corpus pipeline of five operators: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet and reads it again
as the next one's docs. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import functools
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import jaccard, naming, packing, quality, queries, suffixes
from chronoweave.llm.scratch import Scratch, collected


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines the conditional random field calls good enough (operator 2)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(queries.fold(5) != 0)
    return quality.keep_good(docs, quality.train(docs, labels), threshold=0.3)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest doc_id (operator 9)."""
    return naming.keep_largest(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a shingle Jaccard similarity of 0.75 or more, the one with the smallest doc_id (operator 1)."""
    return jaccard.keep_one(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more stay at their first place only; n_chars follows (operator 3)."""
    return suffixes.remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens (operator 6)."""
    return packing.pack(docs, queries.vocabulary("byte_bpe_50k.json")).drop("ids")


#: Of each thread, by place of the stage: tables that its result still reads.
_left = threading.local()


def _stage(place: int, f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``f``, which first clears the tables that the thread's stage before needed for its result: that is written by
    now, as this stage reads it. Runs in other threads, and other stages' results, keep theirs."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        held = _left.__dict__.setdefault("tables", {})
        for made in held.pop(place - 1, []):
            made.clear()
        with collected() as made:
            out = f(spark, docs, sf_dir)
        held.setdefault(place, []).extend(made)
        return out

    return run_stage


STAGES = [(name, _stage(i, f)) for i, (name, f) in enumerate((("quality", good_quality), ("exact_dedup", exact_dedup), ("ngram_jaccard", near_dedup), ("suffix_dedup", passage_dedup), ("packing", packed)))]

#: Trained scores, shingle components and BPE are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = queries.documents(spark, sf_dir), Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.save(docs, name)
    return docs
