"""Affine hypotheses against the sequential rule."""

import math
import random

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import affine

OBS = "pair long, source_id long, target_id long, source_ms long, target_ms long"


def plain(rows, n_source, n_target):
    """All hypotheses of one pair, in order, and the margin; rows: (source_id, target_id, source_ms, target_ms)."""
    o = sorted(rows, key=lambda r: (r[2], r[3], r[0], r[1]))
    seeds = [(1.0, float(t - s)) for _, _, s, t in o[:: max(1, len(o) // 96)]][:256]
    step = max(1, len(o) // 48)
    for i in range(0, len(o), step):
        for j in range(i + 1, len(o), step):
            ds, dt = o[j][2] - o[i][2], o[j][3] - o[i][3]
            if o[i][0] != o[j][0] and abs(ds) >= 500 and 0.94 <= dt / ds <= 1.06 and len(seeds) < 768:
                seeds.append((dt / ds, o[i][3] - dt / ds * o[i][2]))

    def select(scale, offset):
        best = {}
        for sid, tid, s, t in o:
            res = math.floor(abs(t - (scale * s + offset)) + 0.5)
            if res <= 90 and (sid not in best or (res, t) < best[sid][:2]):
                best[sid] = (res, t, s)
        out, last = [], -math.inf
        for sid, (res, t, s) in sorted(best.items(), key=lambda x: (x[1][2], x[0])):
            if t > last:
                out.append((s, t, res))
                last = t
        return out

    found = []
    for scale, offset in seeds:
        hit = select(scale, offset)
        for _ in range(2):
            if hit is None or len(hit) < 4:
                hit = None
                break
            ms, mt = sum(h[0] for h in hit) / len(hit), sum(h[1] for h in hit) / len(hit)
            under = sum((h[0] - ms) ** 2 for h in hit)
            scale = sum((h[0] - ms) * (h[1] - mt) for h in hit) / under if under else math.inf
            if not 0.94 <= scale <= 1.06:
                hit = None
                break
            offset = mt - scale * ms
            hit = select(scale, offset)
        if hit is None or len(hit) < 4:
            continue
        off = math.floor(offset + 0.5) if offset >= 0 else math.ceil(offset - 0.5)
        if any(abs(f["scale"] - scale) < 0.0005 and abs(f["offset"] - off) < 40 for f in found):
            continue
        r = sorted(h[2] for h in hit)
        found.append({"scale": scale, "offset": off, "n": len(hit), "p95": r[math.ceil((len(r) - 1) * 0.95)], "p50": r[math.ceil((len(r) - 1) * 0.5)], "max": r[-1]})
    found.sort(key=lambda f: (-f["n"], f["p95"], abs(f["offset"]), f["scale"]))
    score = [f["n"] - f["p95"] / 180 for f in found[:2]] + [0.0]
    margin = min(1.0, max(0.0, (max(score[0], 0.001) - score[1]) / max(score[0], 0.001))) if found else 0.0
    return seeds, found, margin


@pytest.fixture(scope="module")
def observations():
    r, out = random.Random(11), {}
    for pair, (n, noise) in enumerate([(150, 60), (40, 30), (3, 0), (230, 100), (12, 0)]):
        scale, offset = r.choice([0.97, 1.0, 1.02]), r.randint(-20_000, 20_000)
        rows = []
        for k in range(n):
            s = r.randrange(0, 300_000)
            rows.append((k, k, s, int(s * scale + offset + r.randint(-60, 60))))
        for k in range(noise):  # other targets of the same landmarks, and another line
            s = rows[k % n][2]
            rows.append((k % n, n + k, s, r.choice([int(s + 5_000 + r.randint(-50, 50)), r.randrange(0, 300_000)])))
        out[pair] = rows + rows[:1]
    return out


def test_hypotheses_equal_the_rule(spark, observations):
    df = spark.createDataFrame([(p, *x) for p, rows in observations.items() for x in rows], OBS).cache()
    totals = spark.createDataFrame([(p, 500, 700) for p in observations], "pair long, n_source long, n_target long")
    seeds = {}
    for r in affine.seeds(df).orderBy("pair", "seed").collect():
        seeds.setdefault(r["pair"], []).append((r["scale"], r["offset"]))
    result = affine.hypotheses(df, totals)
    got = {}
    for r in result.orderBy("pair", "rank").collect():
        got.setdefault(r["pair"], []).append(r)
    supported = {(r["pair"], r["rank"]): r["n"] for r in affine.evidence(result, df).groupBy("pair", "rank").agg(F.count("*").alias("n")).collect()}
    for p, rows in observations.items():
        want_seeds, want, margin = plain(rows, 500, 700)
        assert [v for x in seeds.get(p, []) for v in x] == pytest.approx([v for x in want_seeds for v in x])
        mine = got.get(p, [])
        assert [(r["offset_ms"], r["n_inliers"], r["p50_ms"], r["p95_ms"], r["max_ms"]) for r in mine] == [(f["offset"], f["n"], f["p50"], f["p95"], f["max"]) for f in want]
        assert [r["scale"] for r in mine] == pytest.approx([f["scale"] for f in want])
        if mine:
            assert mine[0]["margin"] == pytest.approx(margin) and mine[0]["source_coverage"] == mine[0]["n_inliers"] / 500
            assert all(supported[p, r["rank"]] == r["n_inliers"] for r in mine)
    assert len(seeds[3]) == 768 and 2 not in got and len(got[0]) > 1
    assert affine.hypotheses(df.limit(0), totals).count() == 0


def test_short_pairs_without_joins_as_long_ones(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for pair in range(12):
        for k in range(rng.choice((3, 40, 70, 230))):
            sid = rng.randrange(200)
            at = sid * 700 + (rng.randrange(3) * 200 if pair % 4 == 1 else 0)  # some landmarks with several times
            rows.append((pair, sid, k, at, at + 3_000 + rng.randrange(80) if rng.random() < 0.7 else rng.randrange(150_000)))
    rows += [(90, 1, 1, None, 5), *[(90, k, k, k * 900, k * 900) for k in range(9)]]
    o = spark.createDataFrame(rows, OBS)
    short = affine.solved(o.filter("pair < 90"))
    assert "Join" not in short._jdf.queryExecution().toString()
    known = affine.dealt(o.filter("pair < 90")).select(*short.columns)
    plainly = lambda df: sorted(tuple(round(x, 6) for x in r) for r in df.collect())
    assert plainly(short) == plainly(known)
    totals = o.groupBy("pair").agg(F.countDistinct("source_id").alias("n_source"), F.countDistinct("target_id").alias("n_target"))
    whole = lambda: sorted(tuple(round(x, 6) if x is not None else x for x in r) for r in affine.hypotheses(o, totals).collect())
    monkeypatch.setattr(affine, "CELLS", 500)
    got = whole()
    assert any(r[0] == 90 for r in got)
    monkeypatch.setattr(affine, "LONG", 0)
    assert whole() == got
