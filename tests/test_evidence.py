"""Evidence operators against plain Python, and their edges."""

import numpy as np
import pytest
from chronoweave.operators import evidence, solve
from pyspark.sql import Window
from pyspark.sql import functions as F


def test_refined_finds_the_shift_and_knows_its_edges():
    rng = np.random.default_rng(5)
    s = rng.integers(-20_000, 20_000, 4_000)
    t = np.concatenate([rng.integers(-20_000, 20_000, 37), s])
    for side in ("centred", "before", "after"):
        shift, a, z, c, gap, doubtful = evidence.refined(s, t, 2_000, 2_000, 1_000, 100, 64, 0.01, 0.55, 0.01, 120, side)
        assert (shift, a, z, doubtful) == (37, 2_037, 2_037, False) and c == pytest.approx(1) and gap > 0.3
    flat = evidence.refined(np.zeros(4_000), t, 2_000, 2_000, 1_000, 10, 64, 0.01, 0.55, 0.01, 120, "centred")
    assert flat[0] == 0 and flat[5] and flat[1:3] == (1_990, 2_010)
    assert evidence.refined(s, t, 10, 2_000, 1_000, 10, 64, 0.01, 0.55, 0.01, 120, "centred") is None
    assert evidence.refined(s, t, 2_000, 5, 1_000, 10, 64, 0.01, 0.55, 0.01, 120, "centred") is None
    assert evidence.refined(s, s[:8], 2_000, 2_000, 1_000, 10, 64, 0.01, 0.55, 0.01, 120, "centred") is None


def test_refine_boundaries_keeps_rows_with_nulls(spark):
    df = spark.createDataFrame([(1, None, [1], 5, 5), (2, [1] * 9, [1] * 9, None, 4)], "id long, s array<int>, t array<int>, at long, near long")
    got = evidence.refine_boundaries(df, "s", "t", "at", "near", rate=1_000, radius=1, window=8).orderBy("id").collect()
    assert [(r.id, r.shift_ms, r.refined_ms) for r in got] == [(1, None, None), (2, None, None)]
    assert evidence.refine_boundaries(df.filter("id > 5"), "s", "t", "at", "near").count() == 0


def test_greedy_matches_against_all_pairs(spark):
    rng = np.random.default_rng(9)

    def edits(n):
        a = rng.integers(0, 3_000, (n, 2))
        w = rng.integers(0, 120, (n, 2))
        return [(int(k), "cut" if rng.random() < 0.5 else "added", int(x), int(x + u), int(y), int(y + v), int(rng.integers(2))) for k, ((x, y), (u, v)) in enumerate(zip(a, w))]

    gold, pred = edits(60), edits(70)
    gold += [(100, "cut", 9_000, 9_010, 9_000, 9_010, 0)]
    pred += [(100, "added", 9_000, 9_010, 9_000, 9_010, 0), (101, "cut", 9_000, 9_010, 9_000, 9_010, 0)]
    want = []
    for key in (0, 1):
        pairs = []
        for g in gold:
            for p in pred:
                if g[6] == p[6] == key:
                    e = [abs(a - b) for a, b in zip(g[2:6], p[2:6])]
                    if max(e) <= 400:
                        pairs.append((max(e), sum(e), g[1] != p[1], g[2], g[4], g[0], p[2], p[4], p[0]))
        used_g, used_p = set(), set()
        for r in sorted(pairs):
            if r[5] not in used_g and r[8] not in used_p:
                used_g.add(r[5])
                used_p.add(r[8])
                want.append((key, r[5], r[8], r[0], r[1]))
    schema = "event_id long, kind string, source_start_ms long, source_end_ms long, target_start_ms long, target_end_ms long, k long"
    found = evidence.greedy_matches(spark.createDataFrame(gold, schema), spark.createDataFrame(pred, schema), "k", within=400)
    got = sorted((r.k, r.gold_id, r.predicted_id, r.max_error_ms, r.total_error_ms) for r in found.collect())
    assert got == sorted(want) and (0, 100, 101, 0, 0) in got


def test_block_offsets_short_recordings(spark):
    schema = "k string, t long, v array<double>"
    rows = [("one", 0, [1.0]), ("two", 0, [1.0]), ("two", 10, [2.0]), ("none", 0, [1.0])]
    whole = [("one", 0, [5.0]), ("one", 10, [1.0]), ("two", 0, [0.0]), ("two", 10, [1.0]), ("two", 20, [2.0])]
    got = evidence.block_offsets(spark.createDataFrame(rows, schema), spark.createDataFrame(whole, schema), "k", "t", "v", 10, margin=100, most=100).collect()
    assert sorted((r.k, r.i, r.source_ms, r.offset_ms, r.distance) for r in got) == [("one", 0, 0, 10, 0.0), ("two", 1, 10, 10, 0.0)]


def test_holdout_blocks_leave_enough(spark):
    rows = [("a", i * 1_000 + 1, i) for i in range(50)] + [("few", 0, 1), ("few", 1_000, 2)]
    points = spark.createDataFrame(rows, "k string, t long, id long")
    assert {r.k for r in evidence.holdout_blocks(points, "k", "t", "id", 8).collect()} == {"a"}
    strata = sorted(r.block // 5 for r in evidence.holdout_blocks(points, "k", "t", "id", 8).collect())
    assert strata == list(range(10))
    assert evidence.holdout_blocks(points, "k", "t", "id", 47).count() == 3
    assert evidence.holdout_blocks(points, "k", "t", "id", 49).count() == 0


def test_matches_of_equally_partitioned_sides(spark):
    """Spark 4.1 takes a union of equally partitioned sides for partitioned, and windows over it then miss rows."""
    schema = "event_id long, kind string, source_start_ms long, source_end_ms long, target_start_ms long, target_end_ms long, k long"
    side = lambda shift: spark.createDataFrame([(i, "cut", i * 10 + shift, i * 10 + shift, i * 10 + shift, i * 10 + shift, i % 3) for i in range(90)], schema)
    numbered = lambda df: df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("event_id"))).filter("n > 0").drop("n")
    found = evidence.greedy_matches(numbered(side(0)), numbered(side(3)), "k", within=8)
    assert sorted((r.gold_id, r.predicted_id, r.max_error_ms) for r in found.collect()) == [(i, i, 3) for i in range(90)]
    near = solve.near_in_time(numbered(side(0)).select("k", F.col("source_start_ms").alias("g")), numbered(side(3)).select("k", F.col("source_start_ms").alias("p")), ["k"], 8)
    # Edits of one key are 30 ms apart, so each pair is a stretch of its own.
    assert near.select("k", "_stretch").distinct().count() == near.count() == 90
