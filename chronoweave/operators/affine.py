"""Affine hypotheses of how one recording's times map to another's, from matched landmarks.

The plan: seeds are joins of evenly spaced observations of a pair, so their number has a bound (SEEDS a pair). Every seed
meets all observations of its pair: the best one of each source landmark, the monotone ones by a running maximum, and a
refit. A pair of up to LONG observations is a stretch of sorted rows in one task, where this is numpy over a bounded number
of seeds and observations at once, so that only observations are shuffled. A longer pair is dealt out by its seeds: a join
whose residual filter keeps the near ones, and aggregates. Both give the same rows.

Observations are rows (pair, source_id, target_id, source_ms, target_ms).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import evaluate, graph

# Seeds of a pair, evenly spaced observations, least time apart, scales, tolerance, inliers, near equals.
SEEDS, SINGLE, COUPLE, APART_MS, SCALES, WITHIN_MS, INLIERS, SAME_SCALE, SAME_MS = 768, 96, 48, 500, (0.94, 1.06), 90, 4, 0.0005, 40
# Observations of a pair that one task holds, and cells of seeds by observations that it works on at once.
LONG, CELLS = 200_000, 1 << 20


def seeds(observations: DataFrame) -> DataFrame:
    """(pair, seed, scale, offset): scale 1 through every n // 96-th observation in order of source and target time, at most a
    third of all; then the lines through couples of every n // 48-th one, with 500 ms or more between them, another source
    landmark, and a scale of 0.94 to 1.06. In this order, SEEDS a pair."""
    w = Window.partitionBy("pair").orderBy("source_ms", "target_ms", "source_id", "target_id")
    o = observations.withColumn("r", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("pair")))
    step = lambda k: F.greatest(F.lit(1), F.floor(F.col("n") / k))
    single = o.filter(F.col("r") % step(SINGLE) == 0).filter(F.col("r") / step(SINGLE) < SEEDS // 3)
    single = single.select("pair", F.col("r").alias("i"), F.lit(-1).cast("long").alias("j"), F.lit(1.0).alias("scale"), (F.col("target_ms") - F.col("source_ms")).cast("double").alias("offset"))
    named = lambda df, x: df.select("pair", *[F.col(c).alias(f"{x}_{c}") for c in ("r", "source_id", "source_ms", "target_ms")])
    # The second one of a couple is a number of steps after the first one's successor.
    a, b = named(o.filter(F.col("r") % step(COUPLE) == 0), "a"), named(o.filter(F.col("r") % step(COUPLE) == 1 % step(COUPLE)), "b")
    scale = (F.col("b_target_ms") - F.col("a_target_ms")) / (F.col("b_source_ms") - F.col("a_source_ms")).cast("double")
    couples = a.join(b, "pair").filter((F.col("a_r") < F.col("b_r")) & (F.col("a_source_id") != F.col("b_source_id")) & (F.abs(F.col("b_source_ms") - F.col("a_source_ms")) >= APART_MS))
    couples = couples.withColumn("scale", scale).filter(F.col("scale").between(*SCALES))
    couples = couples.select("pair", F.col("a_r").alias("i"), F.col("b_r").alias("j"), "scale", (F.col("a_target_ms") - F.col("scale") * F.col("a_source_ms")).alias("offset"))
    order = Window.partitionBy("pair").orderBy(F.col("j") >= 0, "i", "j")
    every = graph.cut(single.unionByName(couples))
    return every.withColumn("seed", F.row_number().over(order) - 1).filter(F.col("seed") < SEEDS).select("pair", "seed", "scale", "offset")


def inliers(models: DataFrame, observations: DataFrame, within: int = WITHIN_MS) -> DataFrame:
    """models (pair, seed, scale, offset) with each observation that supports them: of every source landmark the one with the
    least residual (of equals the earliest target), of these in order of source time those whose target is later than all
    before. Adds source_id, target_id, source_ms, target_ms, residual_ms."""
    residual = F.floor(F.abs(F.col("target_ms") - (F.col("scale") * F.col("source_ms") + F.col("offset"))) + 0.5).cast("long")
    near = models.join(observations, "pair").withColumn("residual_ms", residual).filter(F.col("residual_ms") <= within)
    best = near.groupBy("pair", "seed", "scale", "offset", "source_id").agg(F.min(F.struct("residual_ms", "target_ms", "target_id", "source_ms")).alias("b"))
    best = best.select("pair", "seed", "scale", "offset", "source_id", "b.*")
    before = F.max("target_ms").over(Window.partitionBy("pair", "seed").orderBy("source_ms", "source_id").rowsBetween(Window.unboundedPreceding, -1))
    return best.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("target_ms") > F.col("_before"))).drop("_before")


def refitted(models: DataFrame, observations: DataFrame, within: int = WITHIN_MS, least: int = INLIERS) -> DataFrame:
    """Models through their inliers by least squares; those with fewer than ``least``, or of a scale out of bounds, go."""
    fit = inliers(models, observations, within).groupBy("pair", "seed").agg(F.count("*").alias("n"), F.regr_slope("target_ms", "source_ms").alias("scale"), F.avg("source_ms").alias("s"), F.avg("target_ms").alias("t"))
    fit = fit.filter((F.col("n") >= least) & F.col("scale").between(*SCALES))
    return fit.select("pair", "seed", "scale", (F.col("t") - F.col("scale") * F.col("s")).alias("offset"))


def hypotheses(observations: DataFrame, totals: DataFrame, within: int = WITHIN_MS, least: int = INLIERS) -> DataFrame:
    """All hypotheses of each pair: pair, rank, seed, scale, offset_ms, fitted_offset, n_inliers, source_coverage,
    target_coverage, source_start_ms, source_end_ms, p50_ms, p95_ms, max_ms, and margin on the first one.

    Every seed is refitted twice. In the order of seeds, a model within 0.0005 of scale and 40 ms of one before is left out.
    Rank by inliers, 95th percentile, source and target coverage, nearness to 0, scale. margin: how far the first one's
    inliers, less p95 in units of twice the tolerance, are ahead of the second's, as a share. totals (pair, n_source,
    n_target): landmarks of both sides. Rows that stand for held-out evidence are left out by the caller. A pair without
    enough inliers has no row."""
    whole = observations.filter("pair is not null")
    nulls = F.count_if(F.expr("source_id is null or target_id is null or source_ms is null or target_ms is null"))
    long = whole.groupBy("pair").agg(F.count("*").alias("n"), nulls.alias("nulls")).filter((F.col("n") > LONG) | (F.col("nulls") > 0)).select("pair")
    if long.head(1):
        kept = solved(whole.join(long, "pair", "left_anti"), within, least).unionByName(dealt(whole.join(long, "pair", "left_semi"), within, least))
    else:
        kept = solved(whole, within, least)
    kept = kept.join(totals, "pair")
    share = lambda n: F.col("n_inliers") / F.greatest(F.lit(1), F.col(n))
    kept = kept.withColumns({"source_coverage": share("n_source"), "target_coverage": share("n_target")})
    order = Window.partitionBy("pair").orderBy(F.desc("n_inliers"), "p95_ms", F.desc("source_coverage"), F.desc("target_coverage"), F.abs("offset_ms"), "scale", "seed")
    return margins(kept.withColumn("rank", F.row_number().over(order)), order, within).select(
        "pair", "rank", "seed", "scale", "offset_ms", F.col("offset").alias("fitted_offset"), "n_inliers", "source_coverage", "target_coverage", "source_start_ms", "source_end_ms", "p50_ms", "p95_ms", "max_ms", "margin"
    )


_FOUND = "seed long, scale double, offset double, n_inliers long, source_start_ms long, source_end_ms long, offset_ms long, p50_ms long, p95_ms long, max_ms long"


def dealt(observations: DataFrame, within: int = WITHIN_MS, least: int = INLIERS) -> DataFrame:
    """Refitted seeds that no earlier one is near to, with their measures, by joins: a pair's seeds are many tasks."""
    models = seeds(observations)
    for _ in range(2):
        models = graph.cut(refitted(models, observations, within, least))
    at = lambda q: F.get("r", F.ceil((F.size("r") - 1) * q).cast("int"))
    found = inliers(models, observations, within).groupBy("pair", "seed", "scale", "offset").agg(F.count("*").alias("n_inliers"), F.min("source_ms").alias("source_start_ms"), F.max("source_ms").alias("source_end_ms"), F.array_sort(F.collect_list("residual_ms")).alias("r"))
    half_up = F.when(F.col("offset") >= 0, F.floor(F.col("offset") + 0.5)).otherwise(F.ceil(F.col("offset") - 0.5)).cast("long")
    found = found.filter(F.col("n_inliers") >= least).withColumn("offset_ms", half_up).withColumns({"p50_ms": at(0.5), "p95_ms": at(0.95), "max_ms": F.element_at("r", -1)})
    listed = found.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("seed", "scale", "offset_ms"))).alias("m"))
    near = lambda x, y: (F.abs(x["scale"] - y["scale"]) < SAME_SCALE) & (F.abs(x["offset_ms"] - y["offset_ms"]) < SAME_MS)
    apart = F.aggregate("m", F.filter("m", lambda x: F.lit(False)), lambda got, x: F.when(F.exists(got, lambda y: near(x, y)), got).otherwise(F.concat(got, F.array(x))))
    return found.join(listed.select("pair", F.explode(apart).alias("x")).select("pair", "x.seed"), ["pair", "seed"]).drop("r").withColumn("seed", F.col("seed").cast("long"))


def solved(observations: DataFrame, within: int = WITHIN_MS, least: int = INLIERS) -> DataFrame:
    """The rows of ``dealt`` for pairs that one task can hold: observations without nulls, sorted by pair and in the order of
    ``seeds``, are solved pair by pair as they stream by."""
    columns = ["pair", "source_ms", "target_ms", "source_id", "target_id"]
    names = [f.split(" ")[0] for f in _FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(parts: list[pa.Table]) -> list[pa.Array]:
            t = pa.concat_tables(parts)
            s, z = (t.column(k).to_numpy().astype(np.int64) for k in (1, 2))
            a, b = (np.unique(t.column(k).to_numpy(), return_inverse=True)[1] for k in (3, 4))
            return _pair_models(s, z, a, b, within, least)

        def out(ready: list[tuple]) -> pa.RecordBatch:
            pairs = pa.array([p for p, m in ready for _ in range(len(m[0]))], kind)
            types = [pa.float64() if n in ("scale", "offset") else pa.int64() for n in names]
            return pa.RecordBatch.from_arrays([pairs, *[pa.array(np.concatenate([m[k] for _, m in ready]), t) for k, t in enumerate(types)]], ["pair", *names])

        held, pair, ready, kind = [], None, [], None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            kind, ps = t.schema.field(0).type, t.column(0).to_pylist()
            cuts = [0, *[i for i in range(1, len(ps)) if ps[i] != ps[i - 1]], len(ps)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if held and ps[i] != pair:
                    ready.append((pair, solve(held)))
                    held = []
                held, pair = [*held, t.slice(i, j - i)], ps[i]
            if sum(len(m[0]) for _, m in ready) > 5_000:
                yield out(ready)
                ready = []
        if held:
            ready.append((pair, solve(held)))
        if ready:
            yield out(ready)

    kind = observations.schema["pair"].dataType.simpleString()
    dealt_out = observations.select(*columns).repartition("pair").sortWithinPartitions(*columns)
    return dealt_out.mapInArrow(run, f"pair {kind}, {_FOUND}")


def _pair_seeds(s: np.ndarray, t: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scales and offsets of ``seeds`` for one pair's observations in order."""
    n = len(s)
    r, one, two = np.arange(n), max(1, n // SINGLE), max(1, n // COUPLE)
    single = r[(r % one == 0) & (r / one < SEEDS // 3)]
    i, j = (x.ravel() for x in np.meshgrid(r[r % two == 0], r[r % two == 1 % two], indexing="ij"))
    fit = (i < j) & (a[i] != a[j]) & (np.abs(s[j] - s[i]) >= APART_MS)
    i, j = i[fit], j[fit]
    scale = (t[j] - t[i]) / (s[j] - s[i]).astype(float)
    fit = (scale >= SCALES[0]) & (scale <= SCALES[1])
    i, scale = i[fit], scale[fit]
    scales = np.concatenate([np.ones(len(single)), scale])[:SEEDS]
    return scales, np.concatenate([(t[single] - s[single]).astype(float), t[i] - scale * s[i]])[:SEEDS]


def _pair_models(s: np.ndarray, t: np.ndarray, a: np.ndarray, b: np.ndarray, within: int, least: int) -> list[np.ndarray]:
    """``_FOUND`` of one pair: times and codes of both sides' landmarks of its observations, in the order of ``seeds``."""
    scale, offset = _pair_seeds(s, t, a)
    seed = np.arange(len(scale))
    by = np.lexsort((s, b, t, a))  # of equal residuals of a source landmark, the first
    s, t, a = s[by], t[by], a[by]
    first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    n, lowest = len(s), np.iinfo(np.int64).min
    step = max(1, CELLS // n)
    # Where a landmark has one time, the order of landmarks is the same for all lines.
    steady = bool((np.minimum.reduceat(s, first) == np.maximum.reduceat(s, first)).all())
    ahead = np.argsort(s[first], kind="stable")

    def supported(scale: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, ...]:
        """(inlier or not, source and target time, residual) of every line and source landmark, in order of source time."""
        residual = np.abs(t - (scale[:, None] * s + offset[:, None]))
        residual += 0.5
        np.minimum(np.floor(residual, out=residual), within + 1, out=residual)
        # One number of residual and place: exact, as both together are below 2^53.
        residual *= n
        residual += np.arange(n)
        low = np.minimum.reduceat(residual, first, axis=1)
        residual = np.floor(low / n)
        at = (low - residual * n).astype(np.int64)
        if steady:
            residual, at = residual[:, ahead], at[:, ahead]
        else:
            order = np.argsort(s[at], axis=1, kind="stable")
            residual, at = np.take_along_axis(residual, order, 1), np.take_along_axis(at, order, 1)
        near, z = residual <= within, t[at]
        reach = np.maximum.accumulate(np.where(near, z, lowest), axis=1)
        before = np.concatenate([np.full((len(z), 1), lowest), reach[:, :-1]], axis=1)
        return near & (z > before), s[at], z, residual

    for _ in range(2):
        fits = [np.zeros((0, 3))]
        for k in range(0, len(seed), step):
            hit, x, y, _r = supported(scale[k : k + step], offset[k : k + step])
            m = np.maximum(1, hit.sum(1))
            mx, my = (x * hit).sum(1) / m, (y * hit).sum(1) / m
            dx = (x - mx[:, None]) * hit
            square = (dx * dx).sum(1)
            slope = np.divide((dx * (y - my[:, None])).sum(1), square, out=np.full(len(m), np.nan), where=square > 0)
            slope[hit.sum(1) < least] = np.nan
            fits.append(np.stack([slope, my - slope * mx, seed[k : k + step]], axis=1))
        fit = np.concatenate(fits)
        fit = fit[(fit[:, 0] >= SCALES[0]) & (fit[:, 0] <= SCALES[1])]
        # Seeds of equal inliers have equal lines; all but the first would be left out in the end.
        fit = fit[np.sort(np.unique(fit[:, 0] + 1j * fit[:, 1], return_index=True)[1])]
        scale, offset, seed = fit[:, 0], fit[:, 1], fit[:, 2].astype(np.int64)
    rows = [np.zeros((0, 6), np.int64)]
    for k in range(0, len(seed), step):
        hit, x, _y, residual = supported(scale[k : k + step], offset[k : k + step])
        m = hit.sum(1)
        high = np.iinfo(np.int64).max
        r = np.sort(np.where(hit, residual, high), axis=1)
        at = lambda q: r[np.arange(len(m)), np.ceil((np.maximum(m, 1) - 1) * q).astype(int)]  # noqa: B023, E731
        rows.append(np.stack([m, np.where(hit, x, high).min(1), np.where(hit, x, lowest).max(1), at(0.5), at(0.95), at(1.0)], axis=1))
    row = np.concatenate(rows)
    whole = np.where(offset >= 0, np.floor(offset + 0.5), np.ceil(offset - 0.5)).astype(np.int64)
    keep, rest = [], np.flatnonzero(row[:, 0] >= least)
    while len(rest):
        k = rest[0]
        keep.append(k)
        rest = rest[(np.abs(scale[rest] - scale[k]) >= SAME_SCALE) | (np.abs(whole[rest] - whole[k]) >= SAME_MS)]
    return [seed[keep], scale[keep], offset[keep], row[keep, 0], row[keep, 1], row[keep, 2], whole[keep], row[keep, 3], row[keep, 4], row[keep, 5]] if keep else [np.zeros(0)] * 10


def margins(ranked: DataFrame, order: Column, within: int = WITHIN_MS) -> DataFrame:
    """``ranked`` with the margin of the first hypothesis over the second (0 to 1), null on others."""
    score = F.col("n_inliers") - F.col("p95_ms") / (within * 2.0)
    first, second = F.greatest(score, F.lit(0.001)), F.coalesce(F.lead(score).over(order), F.lit(0.0))
    return ranked.withColumn("margin", F.when(F.col("rank") == 1, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (first - second) / first))))


def evidence(found: DataFrame, observations: DataFrame, within: int = WITHIN_MS) -> DataFrame:
    """(pair, rank, source_ms, target_ms, residual_ms): the observations that support each hypothesis, by its fitted line."""
    models = found.select("pair", F.col("rank").alias("seed"), "scale", F.col("fitted_offset").alias("offset"))
    return inliers(models, observations, within).select("pair", F.col("seed").alias("rank"), "source_ms", "target_ms", "residual_ms")


def held_out(found: DataFrame, observations: DataFrame, within: int = WITHIN_MS) -> DataFrame:
    """(pair, rank, source_id, source_ms, target_ms, residual_ms): what the held-out observations say of each hypothesis
    (pair, rank, scale, offset_ms). An observation counts if its residual is within the tolerance, or if it stands in a cell of
    5 s of source time by 250 ms of residual that has, with the cells around, three distinct source landmarks, targets,
    seconds of source time and seconds of target time. Of each source landmark the one with the least residual counts (of
    equals the earliest target)."""
    off = F.col("target_ms") - (F.col("scale") * F.col("source_ms") + F.col("offset_ms"))
    signed = F.when(off >= 0, F.floor(off + 0.5)).otherwise(F.ceil(off - 0.5)).cast("long")
    every = found.select("pair", "rank", "scale", "offset_ms").join(observations, "pair").withColumn("_signed", signed)
    every = every.withColumn("_s", F.floor(F.col("source_ms") / 1000)).withColumn("_t", F.floor(F.col("target_ms") / 1000))
    cells = evaluate.supported_cells(every, ["pair", "rank"], "source_ms", "_signed", ["source_id", "target_id", "_s", "_t"])
    placed = every.withColumn("cell", F.floor(F.col("source_ms") / 5_000)).withColumn("offset_cell", F.floor(F.col("_signed") / 250))
    known = placed.join(cells.withColumn("_held", F.lit(True)), ["pair", "rank", "cell", "offset_cell"], "left").withColumn("residual_ms", F.abs("_signed"))
    kept = known.filter((F.col("residual_ms") <= within) | F.col("_held"))
    best = kept.groupBy("pair", "rank", "source_id").agg(F.min(F.struct("residual_ms", "target_ms", "source_ms")).alias("b"))
    return best.select("pair", "rank", "source_id", "b.source_ms", "b.target_ms", "b.residual_ms")
