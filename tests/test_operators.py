"""Operators on small inputs with literal expectations, and solvers against exhaustive search."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoweave.functions import episodes
from chronoweave.functions import exprs as X
from chronoweave.functions import text as T
from chronoweave.operators import evaluate, fingerprint, hints, intervals, lifecycle, projection, quality, review, sequence, solve, stats, timeline, timemap
from chronoweave.sources import comments, lists
from chronoweave.streaming import stream
from conftest import rows

ITEM = "item_id long, asset_id string, t_ms long, original_index long, enabled boolean"
CLIP = "clip_id string, asset_id string, timeline_start_ms long, source_in_ms long, source_out_ms long, local_offset_ms long, enabled boolean"
SPAN = "map_id string, span_index long, kind string, source_start_ms long, source_end_ms long, target_start_ms long, target_end_ms long"


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


def test_resolve_places_an_item(spark):
    items = spark.createDataFrame([(1, "a", 4000, 0, True)], ITEM)
    clips = spark.createDataFrame([("c", "a", 10000, 1000, 9000, 250, True)], CLIP)
    adjust = spark.createDataFrame([(1, -100)], "item_id long, adjustment_ms long")
    assert timeline.resolve(items, clips, adjustments=adjust, global_offset_ms=500).first()["final_ms"] == 13650


def test_steps_look_at_the_time_before_them(spark):
    items = spark.createDataFrame([(1, "a", 21 * 60000, 0, True)], ITEM)
    clips = spark.createDataFrame([("c", "a", 0, 0, 10**8, 0, True)], CLIP)
    steps = spark.createDataFrame([(20 * 60000, 45000), (20 * 60000 + 30000, 15000)], "source_at_ms long, target_gap_ms long")
    assert timeline.resolve(items, clips, steps).first()["final_ms"] == 22 * 60000


def test_half_open_clips_and_disabled(spark):
    items = spark.createDataFrame([(1, "a", 1000, 0, True), (2, "b", 5, 1, True)], ITEM)
    clips = spark.createDataFrame([("l", "a", 0, 0, 1000, 0, True), ("r", "a", 0, 1000, 2000, 0, True), ("off", "a", 0, 0, 5000, 0, False)], CLIP)
    off = spark.createDataFrame([(1,)], "item_id long")
    got = timeline.resolve(items, clips, disabled=off).collect()
    assert [(r["clip_id"], r["enabled"]) for r in got] == [("r", False)]


@pytest.mark.parametrize("x,want", [(-2.5, -2), (2.5, 3), (-0.5, 0), (0.49, 0)])
def test_rounding(spark, x, want):
    assert one(spark, X.round_half_up(F.lit(x))) == want


@pytest.mark.parametrize("text,ms", [("12.3456", 12346), ("0.0004", 0), ("7", 7000), ("1.5", 1500), ("-1", None), ("1e3", None), ("", None)])
def test_decimal_seconds(spark, text, ms):
    assert one(spark, X.decimal_seconds_ms(F.lit(text))) == ms


@pytest.mark.parametrize("text,n", [("12.9", 12), ("-3.7", -3), (" ", None), ("x", None), ("Infinity", None), ("NaN", None)])
def test_nullable_long(spark, text, n):
    assert one(spark, X.nullable_long(F.lit(text))) == n


def test_text_forms(spark):
    assert one(spark, X.timecode(F.lit(3723004).cast("long"))) == "01:02:03.004"
    assert one(spark, X.signed_timecode(F.lit(-1500).cast("long"))) == "-00:00:01.500"
    assert one(spark, X.xml_seconds(F.lit(-5).cast("long"))) == "0.000"


def test_distances(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, X.rms_distance(v(1, 2), v(1))) == pytest.approx(2 / 2**0.5)
    assert one(spark, X.cosine_cost(v(1, 0), v(0, 1))) == 1000
    assert one(spark, X.cosine_cost(v(0, 0), v(0, 1))) == 1000
    assert one(spark, X.cosine_cost(v(1, 0), v(-1, 0))) == 2000


def spans(spark, *s):
    return spark.createDataFrame([("m", i, *x) for i, x in enumerate(s)], SPAN)


def project(spark, s, *ts):
    pts = spark.createDataFrame([(i, "m", t) for i, t in enumerate(ts)], "point_id long, map_id string, t_ms long")
    return [(r["status"], r["reason"], r["span_index"], r["target_ms"]) for r in timemap.project_times(pts, s).orderBy("point_id").collect()]


def test_compression_never_reaches_the_end(spark):
    assert project(spark, spans(spark, ("matched", 0, 1000, 0, 3)), 999)[0][3] == 2


def test_doubtful_point_comes_first(spark):
    s = spans(spark, ("matched", 0, 100, 0, 100), ("ambiguous", 100, 100, 100, 150), ("matched", 100, 200, 150, 250), ("targetOnly", 200, 200, 250, 300))
    assert project(spark, s, 99, 100, 101, 200, 201) == [("mapped", None, 0, 99), ("ambiguous", "ambiguousSpan", 1, None), ("mapped", None, 2, 151), ("unmapped", "targetOnlyBoundary", 3, None), ("unmapped", "afterMap", None, None)]


def test_long_spans_do_not_overflow(spark):
    big = 2**52
    assert project(spark, spans(spark, ("matched", 0, big, 0, 2 * big)), big - 1)[0][3] == 2 * big - 2


def test_empty_map(spark):
    assert project(spark, spans(spark).limit(0) if False else spark.createDataFrame([], SPAN), 5) == [("unmapped", "emptyMap", None, None)]


def test_legacy_negative_gap(spark):
    ranges = spark.createDataFrame([("m", 0, 100, 0)], "map_id string, source_start_ms long, source_end_ms long, target_start_ms long")
    rules = spark.createDataFrame([("m", 40, -5)], "map_id string, source_at_ms long, gap_ms long")
    got = [(r["kind"], r["source_start_ms"], r["source_end_ms"]) for r in timemap.legacy_spans(rules, ranges).orderBy("span_index").collect()]
    assert got == [("matched", 0, 40), ("ambiguous", 40, 100)]


def random_spans(n, seed):
    r = random.Random(seed)
    return [(r.randrange(3), i, (a := r.randrange(500)), a + r.choice([0, 1, 5, 40, 300])) for i in range(n)]


def test_range_join_against_all_pairs(spark):
    s = random_spans(60, 1)
    p = [(random.Random(i).randrange(3), i, random.Random(i + 99).randrange(800)) for i in range(200)]
    got = intervals.range_join(spark.createDataFrame(p, "k long, pid long, t long"), spark.createDataFrame(s, "k long, sid long, a long, z long"), "t", "a", "z", on=["k"], width=50)
    assert rows(got.select("pid", "sid")) == sorted(((i, j) for k, i, t in p for q, j, a, z in s if k == q and a <= t < z), key=lambda r: tuple(map(repr, r)))


def test_overlaps_against_all_pairs(spark):
    s = random_spans(70, 2)
    got = intervals.overlap_pairs(spark.createDataFrame(s, "k long, sid long, a long, z long"), ["k"], "sid", "a", "z", 64)
    want = {(k, *sorted((i, j), key=lambda n: (s[n][2], n)), min(z, y) - max(a, b)) for (k, i, a, z), (q, j, b, y) in itertools.combinations([x for x in s if x[3] > x[2]], 2) if k == q and a < y and b < z}
    assert set(map(tuple, got.collect())) == want and got.count() == len(want)


def test_union_length_against_sets(spark):
    s = random_spans(80, 3)
    df = spark.createDataFrame(s, "k long, sid long, a long, z long")
    want = {k: len({t for q, _, a, z in s if q == k for t in range(a, z)}) for k in range(3)}
    assert dict(map(tuple, intervals.union_length(df, ["k"], "a", "z", 37).collect())) == want
    merged = intervals.merged(df, ["k"], "a", "z").collect()
    assert {k: sum(r["z"] - r["a"] for r in merged if r["k"] == k) for k in range(3)} == want


def test_nearest_ties(spark):
    pts = spark.createDataFrame([(1, 100)], "pid long, t long")
    frames = spark.createDataFrame([(7, 90), (8, 110), (9, 500)], "f long, ft long")
    assert intervals.nearest(pts, frames, "t", "ft", 50, "pid", "f").first()["frame_id"] == 7
    assert intervals.nearest(pts, frames, "t", "ft", 50, "pid", "f", later_wins=True).first()["frame_id"] == 8
    assert intervals.nearest(pts, frames, "t", "ft", 5, "pid", "f").count() == 0


def test_density_has_empty_buckets(spark):
    e = spark.createDataFrame([(5, True), (25, True), (26, False)], "t long, enabled boolean")
    assert [r["n_events"] for r in timeline.density(e, "t", 3, 40, 10).orderBy("bucket_ms").collect()] == [1, 0, 1, 0]


def test_projection_accounts_for_every_item(spark):
    items = spark.createDataFrame([(i, "a", i * 10, i, i % 4 != 0) for i in range(20)], ITEM)
    seg = spark.createDataFrame([("s", "content", "a", "src", 0, 120, "t", "m"), ("i", "ignored", "a", "src", 150, 170, None, None)], "segment_id string, kind string, asset_id string, source_id string, source_start_ms long, source_end_ms long, target_id string, map_id string")
    media = spark.createDataFrame([("src", "reference", None), ("t", "target", 50)], "media_id string, role string, duration_ms long")
    bind = spark.createDataFrame([("a", "src")], "asset_id string, source_id string")
    maps = spark.createDataFrame([("m", "confirmed", "src", "t")], "map_id string, state string, source_id string, target_id string")
    s = spans(spark, ("matched", 0, 60, 0, 60), ("sourceOnly", 60, 90, 60, 60), ("ambiguous", 90, 120, 60, 70))
    use = projection.segment_states(seg, bind, media, maps, projection.segment_overlaps(seg))
    assert use.filter("blocker is not null").count() == 0
    c = projection.account(items, projection.project(items, use, s), use).first()
    # 90, 100 and 110 are ambiguous: neither mapped nor source-only.
    assert (c["mapped_items"], c["projected"], c["disabled"], c["source_only"], c["ignored"], c["unexpected_unmapped"]) == (6, 4, 2, 3, 2, 9)
    g = projection.target_groups(projection.project(items, use, s), media).first()
    assert g["n_overflow"] == 1


def test_overlapping_segments_block(spark):
    seg = spark.createDataFrame([("x", "content", "a", "src", 0, 100, "t", "m"), ("y", "ignored", "a", "src", 50, 60, None, None), ("z", "content", "a", "src", 100, 200, "t", "m")], "segment_id string, kind string, asset_id string, source_id string, source_start_ms long, source_end_ms long, target_id string, map_id string")
    assert rows(projection.segment_overlaps(seg).select("left_id", "right_id")) == [("x", "y")]


def test_clusters(spark):
    e = spark.createDataFrame([("a", 1000, "这里删了", 0, 1), ("a", 5000, "剪了吧 没了", 1, 2), ("a", 70000, "删了", 2, 3), ("b", 2000, "删了", 0, 4)], "asset_id string, t_ms long, text string, original_index long, item_id long")
    got = hints.clusters(e, hints.CUT_RULES).collect()
    assert len(got) == 1 and (got[0]["source_at_ms"], got[0]["score"], got[0]["keywords"], got[0]["confidence"]) == (5000, 8, ["删了", "剪了", "没了"], "medium")


def test_boost_counts_once(spark):
    cuts = spark.createDataFrame([(0, 0.5), (10**6, 0.97)], "t long, c double")
    h = spark.createDataFrame([(1,), (2,), (10**6,)], "ht long")
    assert sorted(tuple(r) for r in hints.boosted(cuts, h, "t", "ht", "c").collect()) == [(0, 0.53, True), (10**6, 0.98, True)]


def test_percentiles(spark):
    df = spark.createDataFrame([(1, float(x)) for x in (1, 2, 3, 4, 10)], "k long, v double")
    r = stats.nearest_rank(df, ["k"], "v").first()
    assert (r["p50"], r["p95"], r["max_value"]) == (3, 10, 10)
    assert stats.ceil_rank(df, ["k"], "v", 0.5, "q").first()["q"] == 3


def test_zero_denominators(spark):
    df = spark.createDataFrame([(1, False, False)], "k long, g boolean, p boolean")
    a = stats.precision_recall(df, ["k"], F.col("g"), F.col("p")).first()
    b = stats.precision_recall(df, ["k"], F.col("g"), F.col("p"), empty=0.0).first()
    assert (a["precision"], a["recall"], b["precision"], b["f1"]) == (1, 1, 0, 0)


def test_hysteresis_needs_support(spark):
    v = [0] * 5 + [20000] + [0] * 20 + [12000] * 20 + [0] * 3
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(v)], "k long, i long, o long")
    got = [r["stable"] for r in sequence.stabilise(df, ["k"], ["i"], "o", 1000, 3000).orderBy("i").collect()]
    assert got == [0] * 26 + [12000] * 23


def test_merge_near_goes_by_the_first(spark):
    df = spark.createDataFrame([(1, t, 10, 0.5) for t in (0, 1500, 2500, 4000, 9000)], "k long, t long, g long, c double")
    got = sorted(tuple(r)[1:4] for r in sequence.merge_near(df, ["k"], "t", "g", "c", 2000).collect())
    assert got == [(0, 1500, 20), (2500, 4000, 20), (9000, 9000, 10)]


def test_increasing(spark):
    df = spark.createDataFrame([(1, s, t, r) for s, t, r in ((1, 5, 0.1), (1, 4, 0.2), (2, 3, 0.1), (3, 6, 0.1), (4, 6, 0.0), (5, 9, 0.0))], "k long, s long, t long, r double")
    assert sorted((r["s"], r["t"]) for r in sequence.increasing(df, ["k"], "s", "t", "r").collect()) == [(1, 5), (3, 6), (5, 9)]


def test_even_sampling_of_common_keys(spark):
    v = spark.createDataFrame([(i, i, [0.5, 0.5]) for i in range(100)], "id long, t long, v array<double>")
    got = fingerprint.hash_join(v.filter("id = 0"), v, "v", "t", "id", dims=2, per_key=32)
    assert sorted(r["target_id"] for r in got.collect()) == sorted({s * 100 // 32 for s in range(32)})


def test_quality_helpers(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (None, 5.0)], "k long, v double")
    b = spark.createDataFrame([(2, 2.5), (3, 3.0)], "k long, v double")
    assert rows(quality.orphans(a, b, "k", "k").select("v")) == [(1.0,), (5.0,)]
    assert {r["k"]: r["status"] for r in quality.compare(a.filter("k is not null"), b, ["k"], "v", 1.0).collect()} == {1: "missingRight", 3: "missingLeft"}
    assert sorted(tuple(r) for r in quality.upsert(a.filter("k is not null"), b, ["k"]).collect()) == [(1, 1.0), (2, 2.5), (3, 3.0)]


@pytest.mark.parametrize(
    "name,want",
    [
        ("第二季第1-12集.xml", (2, 1, 12, None, "seasonRange")), ("S02E05-E03.xml", (2, 3, 5, None, "seRange")), ("01-10.xml", (None, 10, 10, None, "plainSingle")), ("第3.2集.xml", (None, 3, 3, 2, "decimalPart")),
        ("第十一季第7话.xml", (11, 7, 7, None, "seasonSingle")), ("Show S01E09 final.xml", (1, 9, 9, None, "seSingle")), ("12.xml", (None, 12, 12, None, "plainSingle")), ("random name.xml", (None, 5, 5, None, "importOrder")), ("第1-3集.xml", (None, 1, 3, None, "plainRange")),
    ],
)
def test_episode_names(spark, name, want):
    r = episodes.parse(spark.createDataFrame([(name, 4)], "file_name string, source_order long")).first()
    assert (r["season"], r["episode_start"], r["episode_end"], r["part"], r["pattern"]) == want


def hypotheses(n, seed):
    r = random.Random(seed)
    return pd.DataFrame([{"project": 1, "id": f"h{i}", "alternative_group": r.choice([None, None, "g1", "g2"]), "source_media": r.randrange(2), "target_media": r.randrange(2), "source_start_ms": (a := r.randrange(0, 9000, 500)), "source_end_ms": a + 2000, "target_start_ms": (b := r.randrange(0, 9000, 500)), "target_end_ms": b + 2000, "score": r.random(), "unique_coverage": r.random(), "alternative_margin": r.random(), "repeated_only": r.random() < 0.2, "blocked": r.random() < 0.1, "source_order": r.choice([None, 1.0, 2.0, 3.0]), "target_order": r.choice([None, 1.0, 2.0, 3.0])} for i in range(n)])


@pytest.mark.parametrize("seed", range(4))
def test_assignment_against_exhaustive_search(seed):
    h = hypotheses(9, seed)
    got = solve.assign(h)
    s = h.sort_values("id").reset_index(drop=True)
    w, (clash, penalty) = solve._weights(s), solve._relations(s)
    best = max(sum(w[i] for i in c) - sum(penalty[i, j] for i, j in itertools.combinations(c, 2)) for k in range(10) for c in itertools.combinations([i for i in range(9) if not s.blocked[i]], k) if not any(clash[i, j] for i, j in itertools.combinations(c, 2)))
    assert got.total[0] == pytest.approx(best) and got.exact.all()
    assert all((got.reason.isna()) == got.selected)


def test_assignment_beam_beyond_the_limit():
    got = solve.assign(hypotheses(30, 5))
    assert not got.exact.any() and got.selected.any()


@pytest.mark.parametrize("seed", range(6))
def test_matching_against_exhaustive_search(seed):
    r = random.Random(seed)
    cost = {(i, j): float(r.randrange(1, 50)) for i in range(5) for j in range(5) if r.random() < 0.5}
    got = solve.match_most(cost, 5, 5)
    best = max((len(p), -sum(cost[e] for e in p)) for k in range(6) for p in itertools.combinations(cost, k) if len({i for i, _ in p}) == len({j for _, j in p}) == k)
    assert (len(got), -sum(cost[e] for e in got)) == best


XML = '<i><d p="1.2345,1,25,16777215,0,0,u,r">a &amp; b</d><d p="bad,1">x</d><d>no fields</d><d p="2,4,25,255,1,0,u,r,extra"></d></i>'


def test_comment_files(spark):
    f = spark.createDataFrame([("f.xml", XML), ("broken.xml", "<i><d")], "asset_id string, xml string")
    e = comments.elements(f)
    got = comments.items(e).filter("asset_id = 'f.xml'").orderBy("original_index").collect()
    assert [(r["t_ms"], r["mode"], r["text"]) for r in got] == [(1235, 1, "a & b"), (0, 1, "x"), (0, None, "no fields"), (2000, 4, "")]
    assert {(r["original_index"], r["code"]) for r in comments.warnings(e).collect()} == {(1, "fewFields"), (1, "badTime"), (2, "missingFields"), (2, "fewFields"), (2, "badTime"), (3, "emptyText")}
    back = comments.round_trip(f).filter("asset_id = 'f.xml'").first()
    assert back["n_items"] == back["n_same"] == 4


def test_extra_fields_stay(spark):
    e = comments.items(comments.elements(spark.createDataFrame([("f", XML)], "asset_id string, xml string"))).withColumn("final_ms", F.col("t_ms") - 100)
    assert 'p="1.900,4,25,255,1,0,u,r,extra"' in comments.documents(e, "asset_id").first()["xml"]


def test_lists(spark):
    df = spark.createDataFrame([("1:30, 0:45；x；1:00:00\r\n7.25;0:60;90m;1:75:00;1:",), (None,)], "text string")
    got = lists.cut_points(df).collect()
    assert got[0]["cut_ms"] == [45_000, 60_000, 90_000, 435_000, 3_600_000, 5_400_000] and got[0]["not_understood"] == ["x", "0:60", "1:75:00"] and got[1]["cut_ms"] is None
    a = spark.createDataFrame([("0:10 -> 0:12 # first\n\nnothing\n# 1:00 -> 2:00\n1:00\t1:05\n5 -> 6\n75:00，1:15:00.5",)], "text string")
    assert [tuple(r) for r in lists.anchor_lines(a).select("line", "source_ms", "target_ms", "warning").orderBy("line").collect()] == [
        (1, None, None, "badTime"), (2, None, None, "notAPair"), (3, 60_000, 65_000, None), (4, None, None, "badTime"), (5, 4_500_000, 4_500_500, None)]
    assert lists.anchors(a).count() == 2
    d = lists.duration_lines(spark.createDataFrame([("S1E2 24:10\n3 90.5\n?\n第2季第7话 = 45分钟\n12\nE9 0:00",)], "text string"))
    assert [tuple(r) for r in d.select("line", "season", "episode", "duration_ms").orderBy("line").collect()] == [
        (1, 1, 2, 1_450_000), (2, None, 3, 5_430_000), (3, None, None, None), (4, 2, 7, 2_700_000), (5, None, 5, 720_000), (6, None, None, None)]
    t = spark.createDataFrame([(x,) for x in ("90", "1:75", "1:05", "1:02:03.5", "59.9999", "1:60:00", "", "0:00:59.25", "100:00:00")], "t string")
    assert [r[0] for r in t.select(lists.timecode_ms(F.col("t"))).collect()] == [None, None, 65_000, 3_723_500, None, None, None, 59_250, 360_000_000]



def test_streaming_density_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(i * 100,) for i in range(200)], "s long").select(F.timestamp_seconds("s").alias("ts"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    q = stream.density(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", "1 hour", "10 minutes").writeStream.outputMode("complete").format("memory").queryName("dens").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.sql("select * from dens")) == rows(stream.density(df, "ts", "1 hour"))


def test_streaming_playback(spark, tmp_path):
    df = spark.createDataFrame([(1, w, m) for w, m in ((0, 0), (500, 500), (700, 500), (1000, 1000), (9000, 1200), (9500, 1700))], "session long, wall_ms long, media_ms long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = stream.playback(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("play").start()
    q.processAllAvailable()
    q.stop()
    # 500 ms, then 500 ms over the stalled row, then a gap, then 500 ms.
    assert spark.sql("select max(played_ms) from play").first()[0] == 1500


def test_decisions_fold_in_order(spark):
    c = spark.createDataFrame([(1, "pending"), (2, "pending"), (3, "accepted"), (4, "blocked")], "candidate_id long, state string")
    d = spark.createDataFrame([(1, 1, "accepted"), (1, 2, "pending"), (2, 1, "accepted"), (2, 2, "blocked"), (3, 1, None), (9, 1, "pending")], "candidate_id long, seq long, to_state string")
    got = {r["candidate_id"]: (r["state"], r["refused"]) for r in lifecycle.decide(c, d).collect()}
    assert got == {1: ("pending", 0), 2: ("accepted", 1), 3: ("accepted", 1), 4: ("blocked", 0)}


def test_interpolation_keeps_equal_points_and_nulls(spark):
    p = spark.createDataFrame([(1, 5, "a", None), (1, 5, "a", None), (1, 10, None, 1), (1, 11, "a", None)], "k long, x long, s string, n long")
    knots = spark.createDataFrame([(1, 0, 0.0), (1, 10, 20.0)], "k long, kx long, ky double")
    got = sorted((r["x"], r["y"]) for r in evaluate.interpolate_between(p, knots, ["k"], "x", "kx", "ky", 100).collect() if r["y"] is not None)
    assert got == [(5, 10.0), (5, 10.0), (10, 20.0)] and evaluate.interpolate_between(p, knots, ["k"], "x", "kx", "ky", 100).count() == 4


def test_comparison_tells_null_values_from_missing_rows(spark):
    a = spark.createDataFrame([(1, None), (2, 1.0), (3, None), (4, 1.0)], "k long, v double")
    b = spark.createDataFrame([(1, None), (2, None), (3, 2.0), (5, None)], "k long, v double")
    got = {r["k"]: r["status"] for r in quality.compare(a, b, ["k"], "v", 0.5).collect()}
    assert got == {2: "differs", 3: "differs", 4: "missingRight", 5: "missingLeft"}


def test_characters_beyond_the_first_plane_and_long_numbers(spark):
    df = spark.createDataFrame([("\U0001f600",), ("a",)], "s string")
    assert [r[0] for r in df.select(T.string_hash(F.col("s"))).collect()] == [55_357, 97]
    labels = ["e9", "e10", "e" + "9" * 20, "e1" + "0" * 20, "e" + "0" * 30 + "7", "e2" + "0" * 20]
    got = spark.createDataFrame([(x,) for x in labels], "s string").select("s", review.numeric_key(F.col("s")).alias("k")).orderBy("k").collect()
    assert [r["s"] for r in got] == [labels[i] for i in (4, 0, 1, 2, 3, 5)]


def test_comment_files_as_they_occur(spark):
    made = {
        "space": '<i><d p="1,1,25,1,0,0,u,r">  sp  </d></i>', "mixed": "<i><d>t<b/>u<!-- no --><![CDATA[<&]]></d></i>", "deep": "<r><g><d>in</d></g><d>a<d>b</d>c</d></r>",
        "cut": "<i><d>one</d><d>two</d><d p='1", "wrong": "<i><d>one</d><x></i><d>three</d>", "open": "<i><d>one</d><d>tw", "empty": "", "plain": "<i/>",
    }
    f = spark.createDataFrame([*made.items(), ("none", None)], "asset_id string, xml string")
    got = {}
    for r in comments.elements(f).orderBy("asset_id", "original_index").collect():
        got.setdefault(r["asset_id"], []).append(r["text"])
    assert got == {"space": ["  sp  "], "mixed": ["tu<&"], "deep": ["in", "abc", "b"], "cut": ["one", "two"], "wrong": ["one"], "open": ["one", "tw"]}
    assert {r["asset_id"] for r in comments.file_errors(f).collect()} == {"cut", "wrong", "open", "empty", "none"}
    w = comments.warnings(comments.parsed(f)).filter("severity = 'error'").collect()
    assert len(w) == 5 and all(r["original_index"] is None and r["code"] == "parseError" for r in w)
    snippets = {r["snippet"] for r in comments.elements(f).filter("asset_id = 'deep'").collect()}
    assert any(x.startswith("<d>a<d>b</d>c</d>") for x in snippets)


def test_import_limits(spark, tmp_path):
    few = comments.Limits(file_bytes=400, items=3, p_bytes=20, p_fields=9, text_bytes=5, depth=4, batch_files=2, batch_bytes=10, batch_items=1)
    made = {
        "ok": "<i><d p='1,2'>12345</d><d/></i>", "fileTooLarge": "<i>" + " " * 400 + "</i>", "tooManyItems": "<i>" + "<d/>" * 4 + "</i>", "longFields": f"<i><d p='{'x' * 21}'/></i>",
        "tooManyFields": "<i><d p=',,,,,,,,,'/></i>", "longText": "<i><d>éé<b>é</b></d></i>", "tooDeep": "<i><a><a><a><a/></a></a></a></i>",
    }
    for k, x in made.items():
        (tmp_path / f"{k}.xml").write_text(x)
    f = comments.read_files(spark, f"{tmp_path}/*.xml")
    assert {r["asset_id"]: r["n_bytes"] for r in f.collect()}["ok.xml"] == len(made["ok"])
    assert {r["asset_id"].removesuffix(".xml"): r["code"] for r in comments.file_errors(f, few).collect()} == {k: k for k in made if k != "ok"}
    assert [(r["p"], r["text"]) for r in comments.elements(f, few).collect()] == [("1,2", "12345"), (None, "")]
    assert {r["code"] for r in comments.batch_errors(f, few).collect()} == {"tooManyFiles", "tooManyBytes", "tooManyItemsInAll"} and comments.batch_errors(f).count() == 0


@pytest.mark.parametrize("later", [False, True])
@pytest.mark.parametrize("on", [None, ["k"]])
def test_nearest_against_all_pairs(spark, later, on):
    rng = random.Random(3)
    at = lambda: rng.choice([rng.randrange(-60, 400), rng.randrange(40) * 10, 5_000, None])
    pts = [(i, rng.randrange(3), at()) for i in range(150)]
    frs = [(i, rng.randrange(2), at()) for i in range(60)]
    sign = -1 if later else 1
    want = []
    for i, k, t in pts:
        near = [(abs(t - ft), ft * sign, f * sign) for f, fk, ft in frs if t is not None and ft is not None and abs(t - ft) <= 15 and (not on or k == fk)]
        if near:
            want.append((i, min(near)[2] * sign, min(near)[0]))
    p, f = spark.createDataFrame(pts, "pid long, k long, t long"), spark.createDataFrame(frs, "f long, k long, ft long")
    assert rows(intervals.nearest(p, f, "t", "ft", 15, "pid", "f", on, later)) == sorted(want, key=lambda r: tuple(map(repr, r)))


def test_nearest_of_many_at_one_time_meets_times_only(spark):
    """20,000 points and 20,000 frames of two times: 400 million pairs of rows."""
    p = spark.range(20_000).select(F.col("id").alias("pid"), (F.col("id") % 2 * 10).alias("t"))
    f = spark.range(20_000).select(F.col("id").alias("f"), (F.col("id") % 2 * 10).alias("ft"))
    got = intervals.nearest(p, f, "t", "ft", 100, "pid", "f")
    assert got.filter("frame_id = pid % 2 and distance = 0").count() == 20_000
    seen = got._jdf.queryExecution().optimizedPlan().toString()
    assert "abs(" in seen and not any("Join Inner" in line and "abs(" in line for line in seen.splitlines())


def test_nearest_rank_against_sorted_lists(spark):
    rng = random.Random(11)
    inf, nan = float("inf"), float("nan")
    keyed = {"a": [rng.random() * 1e6 for _ in range(500)], "b": [3.5] * 7, "c": [1e308, -1e308, 1.0, 2.0], "d": [inf, nan, -inf, 0.0, 5.0, nan], "e": [], None: [1e-9 * k for k in range(41)] + [1e12], "f": [nan], "g": [inf, inf]}
    data = [(k, x) for k, xs in keyed.items() for x in [*xs, None]]
    df = spark.createDataFrame(data, "k string, x double")
    got = {r["k"]: tuple(r)[1:] for r in stats.nearest_rank(df, ["k"], "x").collect()}
    for k, xs in keyed.items():
        o = sorted(xs, key=lambda x: (x != x, x))
        want = (*[o[max(1, math.ceil(p * len(o))) - 1] if o else None for p in (0.5, 0.95, 0.99)], o[-1] if o else None, len(o))
        assert repr(got[k]) == repr(want), k
    plan = stats.nearest_rank(df, ["k"], "x")._jdf.queryExecution().executedPlan().toString().lower()
    assert "percentile" not in plan and "objecthashaggregate" not in plan


def test_small_projects_at_once_as_one_by_one(monkeypatch):
    rng = random.Random(2)
    every = []
    for k in range(60):
        h = hypotheses(rng.choice((1, 2, 5, 9, 12, 20)), k)
        h["project"] = k
        if k % 7 == 0:
            h["score"], h["unique_coverage"], h["alternative_margin"], h["repeated_only"] = 0.5, 1.0, 0.0, False  # equal weights
        if k % 9 == 0:
            h["blocked"] = True
        every.append(h)
    monkeypatch.setattr(solve, "STATES", 9_000)
    whole = pd.concat(every).sort_values(["project", "id"], ignore_index=True)
    key = lambda df: sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False)))
    parts = list(solve._assigned(whole))
    assert key(pd.concat(parts)) == key(pd.concat([solve.assign(h) for h in every]))
    assert len(parts) < 40


@pytest.mark.parametrize("size", [1, 7, 1_000])
def test_files_in_parts_read_as_whole_files(spark, size):
    files = {"a": '<i><d p="1,2">x &amp; <b>y</b><d>in\u00e9</d></d>t<d/></i>', "b": "<i><d p='3'>cut <d>off", "c": "<i><d>one</d></j><d>two</d>", "d": ""}
    parts = [(k, n, x[n : n + size]) for k, x in files.items() for n in range(0, max(1, len(x)), size)]
    random.Random(size).shuffle(parts)
    got = comments.elements_of_parts(spark.createDataFrame(parts, "asset_id string, n long, xml string"), ["n"])
    assert rows(got) == sorted(((k, i, p, t) for k, x in files.items() for i, (p, t, _) in enumerate(comments.parse(x)[0])), key=lambda r: tuple(map(repr, r)))


def test_nearest_deals_points_out_twice_only(spark):
    """By bins with the frames, and by id; frames without an id, repeated ids and null ids keep their meaning."""
    p = spark.createDataFrame([(1, 5), (1, 29), (None, 12), (None, 40), (2, 1_000)], "pid long, t long")
    f = spark.createDataFrame([(None, 10), (7, 10), (9, 10), (None, 31), (4, 45)], "f long, ft long")
    got = intervals.nearest(p, f, "t", "ft", 15, "pid", "f")
    assert rows(got) == sorted([(1, None, 2), (None, 7, 2)], key=lambda r: tuple(map(repr, r)))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") + plan.count("LogicalRDD") == 4 and plan.count("Join Inner") == 0 and "FullOuter" not in plan
