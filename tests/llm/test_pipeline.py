"""The corpus pipeline stage by stage against brute force."""

import re
import zlib

from chronoweave.llm import queries
from conftest import DATA
from llm.test_llm import brute_components, brute_passages, library

import corpus_pipeline

SF = f"{DATA}/sf0.001"


def test_stages(spark, tmp_path):
    docs = queries.documents(spark, SF)
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        got.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == columns
            out[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = set(before) - set(out["quality"])
    assert sum(labels.get(i) == 1 for i in gone) <= 1 and sum(labels.get(i) == 0 for i in gone) >= sum(v == 0 for v in labels.values()) * 0.8
    largest = {}
    for i, t in out["quality"].items():
        largest[t] = max(i, largest.get(t, i))
    assert out["exact_dedup"] == {i: t for t, i in largest.items()}
    comp = brute_components(list(out["exact_dedup"].items()))
    assert set(map(str, out["ngram_jaccard"])) == {i for i, _, c in comp if i == c}
    repeats = {i for i, *_, later in brute_passages(list(out["ngram_jaccard"].items())) if later}
    for i, t in out["ngram_jaccard"].items():
        assert i in repeats or out["suffix_dedup"][i] == t
    assert not any(later for *_, later in brute_passages(list(out["suffix_dedup"].items())))
    n = docs.groupBy("doc_id").sum("length").collect()
    tok = library("byte_bpe_50k.json")
    assert {r[0]: r[1] for r in n} == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in out["suffix_dedup"].items()}


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(got.columns)
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5 and re and zlib


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_id long, _row long, _kept string, owner long, n long, score double"


def test_stages_on_nulls_and_clashing_names(spark):
    """Nulls in any column, empty, repeated and very long rows, and columns named as inside; an empty table."""
    long = " ".join(f"w{i}" for i in range(40_000))
    texts = [None, "", " ", "A plain line of good words, as people write them.", "A plain line of good words, as people write them.", long, long + " end", "x" * 300_000]
    rows = [(i if i != 2 else None, t, None, None, None, 1, 2, "k", 3, 4, None) for i, t in enumerate(texts)]
    docs, empty = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SCHEMA)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        got, none = stage(spark, docs, SF), stage(spark, empty, SF)
        assert none.count() == 0
        if name != "packing":
            assert got.columns == docs.columns
            kept[name] = sorted((str(r["doc_id"]), len(r["text"] or "")) for r in got.collect())
    assert len(kept["exact_dedup"]) == 6 and len(kept["ngram_jaccard"]) == 6 and ("4", len(texts[4])) not in kept["ngram_jaccard"]
    assert ("5", len(long)) in kept["suffix_dedup"] and ("6", len(long) + 4) not in kept["suffix_dedup"]
    packed = {(r["doc_id"], r["doc_tokens"]) for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    assert {i for i, _ in packed} == {0, 1, None, 3, 4, 5, 6, 7} and (0, 1) in packed and (1, 1) in packed


def test_two_runs_keep_their_tables(spark):
    """A second run's first stage leaves the first run's result readable."""
    docs = queries.documents(spark, SF)
    stage = dict(corpus_pipeline.STAGES)["exact_dedup"]
    one = stage(spark, docs, SF)
    two = stage(spark, docs, SF)
    assert one.count() == two.count() > 0
