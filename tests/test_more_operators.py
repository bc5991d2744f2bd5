"""Features, alignment, evaluation, project documents and lifecycle."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.functions import text as T
from chronoweave.operators import align, evaluate, features, lifecycle, merge
from chronoweave.plans import fixtures as L
from chronoweave.plans import queries
from chronoweave.sources import project
from conftest import DATA, rows


@pytest.mark.parametrize("seed", range(4))
def test_dense_matches_against_all_ways(seed):
    d = np.random.default_rng(seed).random((5, 4))
    got = align.dense_matches(d, 0.6)
    value = lambda p: sum(1 - d[e] / 0.6 for e in p)
    cells = [c for c in itertools.product(range(5), range(4)) if d[c] <= 0.6]
    best = max(value(p) for k in range(5) for p in itertools.combinations(cells, k) if all(a[0] < b[0] and a[1] < b[1] for a, b in zip(p, p[1:])))
    assert value(got) == pytest.approx(best) and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(got, got[1:]))


def test_a_cut_is_found(spark):
    """Frames 40 to 59 are missing from the source."""
    wave = lambda i: [float(np.sin(i * k / 7)) for k in (1, 2, 3, 5)]
    c = spark.createDataFrame([(1, i * 1000, wave(i)) for i in range(100)], "pair long, t long, v array<double>")
    s = spark.createDataFrame([(1, k * 1000, wave(i)) for k, i in enumerate([*range(40), *range(60, 100)])], "pair long, t long, v array<double>")
    got = align.cuts(align.match_sequences(c, s, "pair", "t", "v")).collect()
    assert sum(r["gap_ms"] for r in got) == 20000 and any(abs(r["source_at_ms"] - 40000) <= 2000 for r in got)


def test_spectrum_finds_a_tone():
    t = np.arange(1024) / 8000
    x = (np.sin(2 * np.pi * 500 * t) * 20000).reshape(1, -1)
    hz = features.LOW_HZ * (1800 / features.LOW_HZ) ** (np.arange(features.BINS) / (features.BINS - 1))
    assert hz[features.spectrum(x, 8000)[0].argmax()] == pytest.approx(500, rel=0.08)
    v = features.fine_features(x, 8000)
    assert v.shape == (1, 14) and np.linalg.norm(v) == pytest.approx(1)


def test_correlation_edges(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [2.0, 4.0, 6.0]), ([1.0], [1.0, 2.0]), ([1.0, 1.0], [1.0, 2.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in df.select(features.correlation("a", "b")).collect()] == [1, -1, 0, -1]


def test_bounded_sample_depends_on_places_only(spark):
    a = spark.createDataFrame([(1, 256 * 5 + i % 7, i * 100) for i in range(40)], "k long, hash long, time_ms long")
    b = a.withColumn("time_ms", F.col("time_ms") * 3 + 17)
    places = lambda df: {r["ordinal"] for r in features.bounded_sample(df, ["k"], 9).collect()}
    assert len(places(a)) == 9 and places(a) == places(b)


def test_mixed_gaps_collapse(spark):
    kinds = ["matched", "sourceOnly", "targetOnly", "sourceOnly", "matched", "sourceOnly", "sourceOnly", "ambiguous"]
    df = spark.createDataFrame([(1, i, k, i, i + 1, i, i + 1, 1) for i, k in enumerate(kinds)], "p long, i long, kind string, source_start_ms long, source_end_ms long, target_start_ms long, target_end_ms long, cost long")
    got = evaluate.collapse_mixed(df, ["p"], "i").orderBy("i").collect()
    assert [(r["kind"], r["source_start_ms"], r["source_end_ms"]) for r in got] == [("matched", 0, 1), ("ambiguous", 1, 4), ("matched", 4, 5), ("sourceOnly", 5, 6), ("sourceOnly", 6, 7), ("ambiguous", 7, 8)]
    assert [r["kind"] for r in evaluate.merge_steps(evaluate.collapse_mixed(df, ["p"], "i"), ["p"], "i").orderBy("span").collect()] == ["matched", "ambiguous", "matched", "sourceOnly", "ambiguous"]


def test_interpolation_at_and_outside_knots(spark):
    knots = spark.createDataFrame([(1, 0, 0), (1, 10, 100), (1, 20, 0)], "k long, x long, v long")
    pts = spark.createDataFrame([(1, 5), (1, 10), (1, 20), (1, 21), (2, 5)], "k long, t long")
    got = {(r["k"], r["t"]): r["y"] for r in evaluate.interpolate_between(pts, knots, ["k"], "t", "x", "v", 8).collect()}
    assert got == {(1, 5): 50, (1, 10): 100, (1, 20): 0, (1, 21): None, (2, 5): None}


def test_search_terms(spark):
    got = {r["q"]: (r["r"]["keyword"], r["r"]["season"], r["r"]["episode"]) for r in L.SEARCHES.df(spark).select("q", T.search_terms(F.col("q")).alias("r")).collect()}
    assert got["Show S1E02"] == ("Show", 1, 2) and got["剧名 第2季第03集"] == ("剧名", 2, 3) and got["Show 1x12 -"] == ("Show", 1, 12) and got["plain words,"] == ("plain words", None, None) and got["E5"] == ("", None, 5) and got["第 7 话 剧"] == ("剧", None, 7)


def test_redaction(spark):
    df = spark.createDataFrame([("see c:\\VIDEO\\a.mkv and C:/video/a.mkv " + "ab" * 32,)], "t string")
    assert df.select(T.redacted(F.col("t"), ["C:\\video\\a.mkv"])).first()[0] == "see [hidden] and [hidden] [hidden sha-256]"


def test_project_documents(spark):
    p = project.parse(L.PROJECTS.df(spark))
    assert sorted((r["error"] or "") for r in p.collect()) == ["", "", "newerVersion", "notAProject"]
    assert rows(project.clips(p).select("clip_id", "source_out_ms", "local_offset_ms", "enabled")) == [("c1", 1000, 0, True), ("c2", 20, -3, True)]
    back = project.parse(project.serialise(p))
    assert rows(project.spans(back)) == rows(project.spans(p)) and back.filter("error is null").count() == 2


def test_decisions(spark):
    c = spark.createDataFrame([(1, "pending"), (2, "rejected"), (3, "accepted"), (4, "pending")], "candidate_id long, state string")
    d = spark.createDataFrame([(1, 1, "rejected"), (1, 2, "accepted"), (2, 1, "accepted"), (3, 1, "pending")], "candidate_id long, seq long, to_state string")
    # Decisions are taken one by one: what was rejected cannot be accepted without being pending again.
    assert [tuple(r) for r in lifecycle.decide(c, d).select("candidate_id", "state", "refused").orderBy("candidate_id").collect()] == [(1, "rejected", 1), (2, "rejected", 1), (3, "pending", 0), (4, "pending", 0)]
    old = spark.createDataFrame([(1, "accepted"), (2, "pending")], "candidate_id long, state string")
    assert rows(lifecycle.reconcile(old, spark.createDataFrame([(1, "pending"), (5, "pending")], "candidate_id long, state string"))) == [(1, "accepted"), (5, "pending")]


def test_split_keeps_the_line(spark):
    got = lifecycle.split_span(L.SPANS.df(spark), "click", 0, L.DAY).filter("map_id = 'click'").orderBy("span_index").collect()
    assert [(r["source_end_ms"], r["target_end_ms"]) for r in got[:2]] == [(L.DAY, 2 * L.DAY), (5 * L.DAY, 6 * L.DAY)] and len(got) == 8


def test_landmark_families_do_not_grow_with_the_table(spark):
    """No family of sf0.1 is over the limit, so every close click and view of a user meet."""
    e = queries.items(spark, f"{DATA}/sf0.1").select("user_id", "asset_id", (F.col("item_id") % 256).alias("b"))
    s, t = (e.filter(F.col("asset_id") == k).select("user_id", F.col("b").alias(k)) for k in ("click", "view"))
    want = s.join(t, "user_id").filter(F.abs(F.col("click") - F.col("view")) <= 1).count()
    assert queries.landmark_join_users(spark, f"{DATA}/sf0.1").count() == want > 0


def test_files_cut_by_hand_or_durations(spark):
    timed = spark.createDataFrame([(a, t) for a in "abc" for t in (100, 500, 900, 1_000)], "asset_id string, mapped_ms long")
    ranges = spark.createDataFrame([("a", None, 1, 3), ("b", None, 1, 3), ("c", 2, 5, 2), ("none", None, 1, 2)], "asset_id string, season int, episode_start int, episodes int")
    cuts = spark.createDataFrame([("a", 300.4), ("a", 100.0), ("a", 600.5), ("a", 700.0), ("b", 400.0), ("c", 1_000.0)], "asset_id string, cut_ms double")
    parts = lambda df, rule: [tuple(r)[:4] for r in df.filter(F.col("rule") == rule).orderBy("asset_id", "part").collect()]
    got = merge.split_ranges(timed, ranges, cuts=cuts)
    assert parts(got, "cutPoints") == [("a", 1, 100, 300), ("a", 2, 300, 601), ("a", 3, 601, 1_001)] and {r["asset_id"] for r in got.filter("rule = 'gaps'").collect()} == {"b", "c"}
    known = spark.createDataFrame([(0, None, 1, 200), (1, None, 2, 300), (2, None, 3, 10), (3, 2, 5, 70)], "place int, season int, episode int, duration_ms long")
    got = merge.split_ranges(timed, ranges.filter("asset_id != 'c'"), known=known)
    assert parts(got, "durations") == [(x, k, a, z) for x in "ab" for k, a, z in ((1, 100, 300), (2, 300, 600), (3, 600, 610))]
    assert merge.split_ranges(timed, ranges).count() == 8


def _plain_dense(d, threshold):
    """The table of ways as a whole, cell by cell."""
    n, m = d.shape
    best, way = np.zeros((n + 1, m + 1)), np.zeros((n + 1, m + 1), int)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            a = best[i - 1, j - 1] + (1 - d[i - 1, j - 1] / threshold if d[i - 1, j - 1] <= threshold else -np.inf)
            ways = (a, best[i - 1, j], best[i, j - 1])
            best[i, j], way[i, j] = max(ways), ways.index(max(ways)) + 1
    out, i, j = [], n, m
    while i and j:
        w = way[i, j]
        i, j = i - (w != 3), j - (w != 2)
        if w == 1:
            out.append((i, j))
    return out[::-1]


@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (17, 5), (16, 16), (40, 33), (0, 3), (3, 0)])
@pytest.mark.parametrize("cells", [16_000_000, 1, 60])
def test_dense_matches_by_stretches(monkeypatch, shape, cells):
    monkeypatch.setattr(align, "CELLS", cells)
    d = np.random.default_rng(7).integers(0, 6, shape) / 8
    assert align.dense_matches(d, 0.6) == _plain_dense(d, 0.6)


def test_sequences_of_more_than_16_million_cells(spark):
    """4,200 by 4,100 frames, of which every 42nd is missing from the source."""
    v = F.array(*[F.sin(F.col("i") * k) for k in (1.0, 2.3, 3.1)])
    f = spark.range(4_200).select(F.lit(1).cast("long").alias("pair"), (F.col("id") * 500).alias("t"), F.col("id").alias("i")).withColumn("v", v)
    got = align.match_sequences(f, f.filter("i % 42 != 0"), "pair", "t", "v", threshold=1e-4)
    assert got.filter("complete_ms = source_ms").count() == got.count() == 4_100


def test_a_cut_in_sequences_of_more_than_16_million_cells(spark):
    """Frames 2,000 to 2,099 are missing from the source, whose times close up."""
    v = F.array(*[F.sin(F.col("i") * k) for k in (1.0, 2.3, 3.1)])
    f = spark.range(4_200).select(F.lit(1).cast("long").alias("pair"), (F.col("id") * 500).alias("t"), F.col("id").alias("i")).withColumn("v", v)
    s = f.filter("i not between 2000 and 2099").withColumn("t", F.when(F.col("i") >= 2_100, F.col("t") - 50_000).otherwise(F.col("t")))
    assert [tuple(r) for r in align.cuts(align.match_sequences(f, s, "pair", "t", "v", threshold=1e-4)).collect()] == [(1, 999_750, 50_000)]


@pytest.mark.parametrize(("shape", "beside"), [((60, 60), 1), ((60, 41), 2), ((33, 70), 4), ((0, 4), 1), ((50, 50), 256)])
@pytest.mark.parametrize("noise", [0, 0.02, 5])
def test_dense_matches_in_a_band(monkeypatch, shape, beside, noise):
    """Near copies with frames left out, and unrelated sequences, for which the band grows to the whole table."""
    monkeypatch.setattr(align, "CELLS", 200)
    monkeypatch.setattr(align, "BESIDE", beside)
    r = np.random.default_rng(shape[1] + beside)
    x = r.random(100)
    a, b = (np.sort(r.permutation(100)[:k]) for k in shape)
    d = np.abs(x[a][:, None] - x[b][None, :]) + noise * r.random(shape)
    assert align.dense_matches(d, 0.3) == _plain_dense(d, 0.3)


def test_memory_of_dense_matches_goes_with_the_lengths():
    """120,000 frames a side: with the sums of every stretch kept, 800 MB."""
    import tracemalloc

    n = 120_000
    tracemalloc.start()
    got = align.traced(lambda a, z, b, y: np.abs(np.arange(a, z)[:, None] - np.arange(b, y)[None, :]) / 4.0, n, n, 0.3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(i, j) for i, j, _ in got] == [(i, i) for i in range(n)] and peak < 300e6


def test_frames_of_one_time_match_alike_in_any_order(spark):
    """Two frames a time and equal vectors among them; one frame has none."""
    f = [(1, k // 2 * 500, [float(k % 3), float(k % 5)]) for k in range(40)] + [(1, 250, None)]
    schema = "pair long, t long, v array<double>"
    found = []
    for g in (f, f[::-1], f[7:] + f[:7]):
        df = spark.createDataFrame(g, schema).repartition(3)
        m = align.match_sequences(df, spark.createDataFrame(g[::-1], schema).filter("t != 3000"), "pair", "t", "v")
        found.append((rows(m), rows(align.cuts(m, 1))))
    assert found[0] == found[1] == found[2] and len(found[0][0]) == 38
