"""Block localisation and banded alignment against plain and exhaustive search."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import banded, localise


def plain_best_two(scores, radius):
    """The sequential rule."""
    best = second = None
    for i, s in enumerate(scores):
        if best is None:
            best = (i, s)
        elif s > best[1]:
            if abs(best[0] - i) > radius:
                second = best
            best = (i, s)
        elif abs(best[0] - i) > radius and (second is None or s > second[1]):
            second = (i, s)
    return best, second


def test_best_two_apart_equals_the_sequential_rule(spark):
    r = random.Random(3)
    lists = [[r.choice([0.1, 0.2, 0.3, 0.5, 0.5, 0.9]) + (r.random() if k % 2 else 0) for _ in range(r.randint(1, 40))] for k in range(60)]
    df = spark.createDataFrame([(k, i, float(s)) for k, x in enumerate(lists) for i, s in enumerate(x)] + [(0, 99, None)], "k long, at long, s double")
    for radius in (0, 2, 7):
        got = {row["k"]: tuple(row)[1:] for row in localise.best_two_apart(df, ["k"], "at", "s", radius).collect()}
        for k, x in enumerate(lists):
            best, second = plain_best_two(x, radius)
            assert got[k] == (*best, *(second or (None, None))), (k, radius)
            assert localise.fold_best_two(np.array(x), radius, 5) == (best[0] + 5, best[1], second and second[0] + 5, second and second[1])


def plain_score(s, t):
    """A block's score by frames, as the rule says it."""
    cos = lambda a, b: 0.0 if not a @ a or not b @ b else float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b))
    total, compared, before = 0.0, 0, None
    for (x, p), (y, q) in zip(s, t):
        if p < 100 or q < 100:
            before = None
            continue
        own = min(1.0, max(0.0, cos(x, y)))
        moved = own
        if before is not None:
            u, v = x - before[0], y - before[1]
            moved = 0.0 if not u @ u or not v @ v else min(1.0, max(0.0, (cos(u, v) + 1) / 2))
        total += own * 0.6 + moved * 0.3 + (1 - abs(p - q) / 1000) * 0.1
        compared += 1
        before = (x, y)
    return 0.0 if compared * 2 < len(t) else total / compared * compared / len(t)


def recording(seed, n):
    g = np.random.default_rng(seed)
    return [(g.integers(0, 255, 12).astype(float), int(g.choice([0, 400, 1000], p=[0.05, 0.15, 0.8]))) for _ in range(n)]


def frames(spark, recordings):
    rows = [(p, i, i * 500, [int(x) for x in v], a) for p, rec in recordings.items() for i, (v, a) in enumerate(rec)]
    return spark.createDataFrame(rows, "pair long, frame long, time_ms long, values array<int>, active int")


def test_place_scores():
    s, t = recording(1, 60), recording(2, 8)
    s[20:28] = t
    s[40] = (np.zeros(12), 1000)
    got = localise.place_scores(np.array([v for v, _ in s]), np.array([a for _, a in s]), np.array([v for v, _ in t]), np.array([a for _, a in t]))
    assert np.allclose(got, [plain_score(s[i : i + 8], t) for i in range(53)]) and got.argmax() == 20


@pytest.fixture(scope="module")
def planted(spark):
    """Pair 1: the target lacks the source's first 90 frames. Pair 2: unrelated. Pair 3: too short. Chunks are passed."""
    one, other, short = recording(4, 2_600), recording(5, 700), recording(6, 5)
    source = {1: one, 2: other, 3: short}
    target = {1: one[90:], 2: recording(7, 900), 3: recording(8, 900)}
    return source, target, frames(spark, source), frames(spark, target)


def test_planted_shift_is_found(spark, planted):
    source, target, s, t = planted
    blocks = localise.locate_blocks(s, t, block=8, stride=96, most_blocks=20)
    rows = blocks.collect()
    assert {r["pair"] for r in rows} == {1, 2} and sum(r["pair"] == 1 for r in rows) == 20
    for r in rows:
        if r["pair"] == 2:
            scores = [plain_score(source[2][i : i + 8], target[2][r["start"] : r["start"] + 8]) for i in range(693)]
            best, second = plain_best_two(scores, 16)
            assert r["place"] == best[0] and abs(r["score"] - best[1]) < 1e-9 and abs(r["margin"] - max(0, best[1] - second[1])) < 1e-9
        else:
            assert r["place"] == r["start"] + 90 and r["source_ms"] == (r["place"] + 4) * 500
    bounds = spark.createDataFrame([(1, 0, 1_255_000), (2, 0, 450_000)], "pair long, start_ms long, end_ms long")
    found = localise.hypotheses(blocks, bounds, least_score=0.7, tolerance=2_000, least_training=5).collect()
    assert [(r["pair"], r["rank"], r["offset_ms"], r["max_ms"]) for r in found] == [(1, 1, -45_000, 0)] and found[0]["n_training"] == 16
    assert localise.summary(blocks).count() == 2
    kept = localise.held_out(s, t, blocks, localise.hypotheses(blocks, bounds, least_score=0.7, tolerance=2_000), block=8, tolerance=2_000, least_score=0.7).collect()
    times = sorted(r["target_ms"] for r in kept)
    assert len(times) > 8 and all(r["residual_ms"] == 0 for r in kept) and all(b - a >= 4_000 for a, b in zip(times, times[1:]))


def test_hypotheses_are_apart_and_in_order(spark):
    rows = [(1, k, k, k, 0.9, 0.1, 10_000 * k, 10_000 * k + off, False) for k, off in enumerate([0, 10, 20, 30, 5, 0, 9_000, 9_010, 9_020, 9_030, 9_040, 9_050, 9_060])]
    blocks = spark.createDataFrame(rows, "pair long, request long, start long, place long, score double, margin double, source_ms long, target_ms long, held_out boolean")
    bounds = spark.createDataFrame([(1, 0, 130_000)], "pair long, start_ms long, end_ms long")
    found = localise.hypotheses(blocks, bounds, tolerance=100).collect()
    assert [(r["offset_ms"], r["n_training"], r["p95_ms"]) for r in found] == [(9_030, 7, 30), (10, 6, 20)]
    assert localise.hypotheses(blocks.limit(0), bounds).count() == 0


# Banded alignment


def exhaustive(cost, inside, semi_global):
    """Cheapest way by trying all, with the band on every cell that is entered."""
    n, m = cost.shape
    from functools import lru_cache

    @lru_cache(None)
    def go(i, j, state):
        """Cheapest way from boundary (i, j), having come in ``state``."""
        best = 0 if i == n and (j == m or semi_global) else float("inf")
        if i < n and j < m and inside[i, j]:
            best = min(best, cost[i, j] + go(i + 1, j + 1, 0))
        if i < n and (j == 0 and started(i, state) or j > 0 and inside[i, j - 1]):
            best = min(best, (60 if state == 1 else 300) + go(i + 1, j, 1))
        if j < m and (i == 0 and not semi_global or i > 0 and inside[i - 1, j]):
            best = min(best, (60 if state == 2 else 300) + go(i, j + 1, 2))
        return best

    def started(i, state):
        return i == 0 or state == 1

    return min(go(0, j, 0) for j in (range(m + 1) if semi_global else (0,)))


@pytest.mark.parametrize("semi_global", [False, True])
@pytest.mark.parametrize("radius", [100, 250, 5_000])
def test_band_equals_exhaustive_search(semi_global, radius):
    g = np.random.default_rng(radius + semi_global)
    for _ in range(25):
        n, m = g.integers(1, 7, 2)
        x, y = g.normal(size=(n, 3)), g.normal(size=(m, 3))
        if g.random() < 0.2:
            x[0] = 0
        xm, ym = np.arange(n) * 50, np.arange(m) * 50
        band = banded.Band(xm, ym, 1.0, 0.0, radius)
        inside = np.array([[abs(ym[j] - xm[i]) <= radius for j in range(m)] for i in range(n)])
        cost = banded._cost(banded._unit(x) @ banded._unit(y).T)
        want = exhaustive(cost, inside, semi_global)
        got = banded.align(x, y, band, semi_global)
        assert (got is None) == (want == float("inf")) and (got is None or got[0] == want)
        if got:
            total, state = 0, 0
            i = 0
            j = got[1][0][2] if got[1] else 0
            for s, a, b in got[1]:
                assert (a, b) == (i, j)
                total += int(cost[i, j]) if s == 0 else 60 if s == state else 300
                i, j, state = i + (s != 2), j + (s != 1), s
            assert total == got[0] and i == n and (semi_global or j == m)


def test_long_sequences_need_no_square():
    g = np.random.default_rng(1)
    x = g.normal(size=(20_000, 4))
    y = np.concatenate([x[:5_000], g.normal(size=(12, 4)), x[5_000:]])
    times = lambda v: np.arange(len(v)) * 50
    total, steps = banded.align(x, y, banded.Band(times(x), times(y), 1.0, 0.0, 2_000))
    assert total == 300 + 11 * 60 and [k for k, *_ in steps].count(2) == 12
    found = banded.spans(steps, x, y, times(x), times(y))
    assert [(r[0], r[1], r[2], r[3], r[4]) for r in found] == [("matched", 0, 250_000, 0, 250_000), ("targetOnly", 250_000, 250_000, 250_000, 250_600), ("matched", 250_000, 1_000_000, 250_600, 1_000_600)]


def test_spans_of_doubt():
    x = np.eye(4)[[0, 1, 2, 3, 0, 1]]
    edges = np.arange(6) * 50
    steps = [(0, 0, 0), (1, 1, 1), (2, 2, 1), (0, 2, 2), (0, 3, 3)]
    found = banded.spans(steps, x, np.eye(4)[[0, 3, 1, 1, 0, 0]], edges, edges)
    # Costs along the diagonal are 0, 1000, 1000, 1000, 0, 1000: the first match averages 667, the third 600, the fourth 800.
    assert [tuple(r[:5]) for r in found] == [("matched", 0, 50, 0, 50), ("ambiguous", 50, 100, 50, 100), ("matched", 100, 150, 100, 150), ("ambiguous", 150, 200, 150, 200)]


def test_aligned_frames(spark):
    g = np.random.default_rng(2)
    x = g.normal(size=(30, 5))
    rows = lambda p, v, t0=0: [(p, t0 + i * 50, [float(c) for c in w]) for i, w in enumerate(v)]
    schema = "pair long, time_ms long, vec array<double>"
    s = spark.createDataFrame(rows(1, x) + rows(2, x[5:9]) + rows(3, x) + rows(4, x), schema)
    t = spark.createDataFrame(rows(1, np.delete(x, slice(10, 14), axis=0)) + rows(2, x) + rows(3, x, 900_000), schema)
    got = [tuple(r)[:5] for r in banded.aligned(s, t).filter("pair != 2").orderBy("pair", "span").collect()]
    assert got == [(1, 0, "matched", 0, 500), (1, 1, "sourceOnly", 500, 700), (1, 2, "matched", 700, 1_500), (3, 0, "noPath", None, None)]
    semi = banded.aligned(s, t, semi_global=True).filter("pair = 2").collect()
    assert [(r["kind"], r["target_start_ms"], r["target_end_ms"], r["total_cost"]) for r in semi] == [("matched", 250, 450, 0)]
    moved = spark.createDataFrame([(3, 1.0, 900_000.0)], "pair long, scale double, offset_ms double")
    assert [r["kind"] for r in banded.aligned(s, t, moved).filter(F.col("pair") == 3).collect()] == ["matched"]
    assert banded.aligned(s.limit(0), t).count() == 0
