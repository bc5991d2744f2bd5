"""Comparing predicted spans and anchors with gold ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import overlap_pairs, range_join


def boundary_candidates(gold: DataFrame, predicted: DataFrame, case: str, within: int) -> DataFrame:
    """Gold and predicted spans of one case and kind whose four bounds all differ by ``within`` at most, with the
    largest difference. The source start's bin joins them."""
    width = max(1, within)
    bounds = ("source_start_ms", "source_end_ms", "target_start_ms", "target_end_ms")
    g = gold.select(case, "kind", F.col("span_id").alias("gold_id"), *[F.col(b).alias(f"g_{b}") for b in bounds]).withColumn("_bin", F.explode(F.array(*[F.floor(F.col("g_source_start_ms") / width) + k for k in (-1, 0, 1)])))
    p = predicted.select(case, "kind", F.col("span_id").alias("predicted_id"), *bounds).withColumn("_bin", F.floor(F.col("source_start_ms") / width))
    worst = F.greatest(*[F.abs(F.col(b) - F.col(f"g_{b}")) for b in bounds])
    return g.join(p, [case, "kind", "_bin"]).withColumn("error_ms", worst).filter(F.col("error_ms") <= within).select(case, "kind", "gold_id", "predicted_id", "error_ms")


def occupancy_conflicts(intervals: DataFrame, medium: str, owner: str, start: str, end: str, width: int, most: int = 250, reuse: str | None = None) -> DataFrame:
    """Owners whose intervals on one medium overlap by more than ``most`` in all; those of one reuse group may."""

    other = F.col(f"a.{owner}") != F.col(f"b.{owner}")
    if reuse:
        other = other & ~F.coalesce(F.col(f"a.{reuse}") == F.col(f"b.{reuse}"), F.lit(False))
    numbered = intervals.withColumn("_key", F.struct(owner, start, end))
    pairs = overlap_pairs(numbered, [medium], "_key", start, end, width, other)
    a, b = F.col(f"left_id.{owner}"), F.col(f"right_id.{owner}")
    return pairs.groupBy(medium, F.least(a, b).alias("first_owner"), F.greatest(a, b).alias("second_owner")).agg(F.sum("overlap").alias("overlap_ms")).filter(F.col("overlap_ms") > most)


def interpolate_between(points: DataFrame, knots: DataFrame, key: list[str], x: str, knot_x: str, knot_y: str, width: int | float) -> DataFrame:
    """Each point's y on the line between the knots around it (the knot's own at a knot); null outside."""
    w = Window.partitionBy(*key).orderBy(knot_x)
    legs = knots.withColumn("_x2", F.lead(knot_x).over(w)).withColumn("_y2", F.lead(knot_y).over(w)).select(*key, F.col(knot_x).alias("_x1"), F.col(knot_y).alias("_y1"), "_x2", "_y2")
    last = legs.filter("_x2 is null").select(*key, F.col("_x1").alias("_xl"), F.col("_y1").alias("_yl"))
    inside = range_join(points, legs.filter("_x2 is not null"), x, "_x1", "_x2", on=key, width=width)
    y = F.col("_y1") + (F.col(x) - F.col("_x1")) / (F.col("_x2") - F.col("_x1")) * (F.col("_y2") - F.col("_y1"))
    found = inside.select(*points.columns, y.alias("y"))
    at_last = points.join(last, [*[points[k] == last[k] for k in key], points[x] == last["_xl"]]).select(*[points[c] for c in points.columns], F.col("_yl").cast("double").alias("y"))
    # Equal points have equal values, so each point meets one row; nulls in other columns meet nulls.
    known = found.unionByName(at_last).distinct()
    known = known.select(*[F.col(c).alias(f"_k_{c}") for c in points.columns], "y")
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in points.columns]
    return points.join(known, same, "left").select(*points.columns, "y")


def calibrated(probability: Column, knots: list[tuple[float, float]]) -> Column:
    """Piecewise-linear calibration; null outside the knots."""
    out = None
    for (a, p), (b, q) in zip(knots, knots[1:]):
        value = F.lit(p) + (probability - a) / (b - a) * (q - p)
        hit = (probability >= a) & (probability <= b)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def collapse_mixed(steps: DataFrame, key: list[str], order: str) -> DataFrame:
    """Runs of gaps that hold both sourceOnly and targetOnly steps become one ambiguous step each."""
    w = Window.partitionBy(*key).orderBy(order)
    gap = F.col("kind").isin("sourceOnly", "targetOnly")
    marked = steps.withColumn("_gap", gap).withColumn("_before", F.lag("_gap").over(w))
    fresh = F.when(F.col("_gap") & F.coalesce("_before", F.lit(False)), 0).otherwise(1)
    runs = marked.withColumn("_run", F.sum(fresh).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    mixed = (F.max((F.col("kind") == "sourceOnly").cast("int")).over(Window.partitionBy(*key, "_run")) + F.max((F.col("kind") == "targetOnly").cast("int")).over(Window.partitionBy(*key, "_run"))) == 2
    tagged = runs.withColumn("_mixed", mixed)
    group = F.when(F.col("_mixed"), F.lit(-1)).otherwise(F.col(order))
    return (
        tagged.withColumn("_group", group)
        .groupBy(*key, "_run", "_group")
        .agg(F.min(order).alias(order), F.first(F.when(F.col("_mixed"), "ambiguous").otherwise(F.col("kind"))).alias("kind"), F.min("source_start_ms").alias("source_start_ms"), F.max("source_end_ms").alias("source_end_ms"), F.min("target_start_ms").alias("target_start_ms"), F.max("target_end_ms").alias("target_end_ms"), F.sum("cost").alias("cost"))
        .drop("_run", "_group")
    )


def merge_steps(steps: DataFrame, key: list[str], order: str) -> DataFrame:
    """Neighbouring steps of one kind that touch on both axes as one span."""
    w = Window.partitionBy(*key).orderBy(order)
    same = (F.lag("kind").over(w) == F.col("kind")) & (F.lag("source_end_ms").over(w) == F.col("source_start_ms")) & (F.lag("target_end_ms").over(w) == F.col("target_start_ms"))
    marked = steps.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("span", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*key, "span").agg(F.first("kind").alias("kind"), F.min("source_start_ms").alias("source_start_ms"), F.max("source_end_ms").alias("source_end_ms"), F.min("target_start_ms").alias("target_start_ms"), F.max("target_end_ms").alias("target_end_ms"))


def local_consensus(pairs: DataFrame, key: list[str], t: str, offset: str, source_id: str, target_id: str, cell_ms: int = 5_000, offset_ms: int = 250, least: int = 3) -> DataFrame:
    """Cells of time by offset with enough distinct sources and targets among the cells around (two in time, one in
    offset). Each pair stands in the 15 cells it supports."""
    here = pairs.withColumn("_a", F.floor(F.col(t) / cell_ms)).withColumn("_o", F.floor(F.col(offset) / offset_ms))
    around = F.explode(F.array(*[F.struct((F.col("_a") + i).alias("cell"), (F.col("_o") + j).alias("offset_cell")) for i in range(-2, 3) for j in (-1, 0, 1)]))
    support = here.select(*key, source_id, target_id, around.alias("c")).groupBy(*key, "c.cell", "c.offset_cell").agg(F.countDistinct(source_id).alias("n_sources"), F.countDistinct(target_id).alias("n_targets"))
    own = here.select(*key, F.col("_a").alias("cell"), F.col("_o").alias("offset_cell")).distinct()
    return support.join(own, [*key, "cell", "offset_cell"], "left_semi").filter((F.col("n_sources") >= least) & (F.col("n_targets") >= least))


def supported_cells(pairs: DataFrame, key: list[str], t: str, offset: str, axes: list[str], cell_ms: int = 5_000, offset_ms: int = 250, least: int = 3) -> DataFrame:
    """(key, cell, offset_cell): cells of time by offset that hold a pair and have, with the cells around (two in time, one in
    offset), ``least`` distinct values on every axis. A cell hands on ``least`` values of an axis, which is enough to know, so
    what is copied to the cells around does not grow with a cell's pairs."""
    here = pairs.withColumn("_a", F.floor(F.col(t) / cell_ms)).withColumn("_o", F.floor(F.col(offset) / offset_ms))
    told = here.select(*key, "_a", "_o", F.posexplode(F.array(*[F.col(x).cast("long") for x in axes])).alias("axis", "value")).distinct()
    few = told.withColumn("_n", F.row_number().over(Window.partitionBy(*key, "_a", "_o", "axis").orderBy("value"))).filter(F.col("_n") <= least)
    around = F.explode(F.array(*[F.struct((F.col("_a") + i).alias("cell"), (F.col("_o") + j).alias("offset_cell")) for i in range(-2, 3) for j in (-1, 0, 1)]))
    n = few.select(*key, "axis", "value", around.alias("c")).groupBy(*key, "c.cell", "c.offset_cell", "axis").agg(F.countDistinct("value").alias("n")).filter(F.col("n") >= least)
    enough = n.groupBy(*key, "cell", "offset_cell").count().filter(F.col("count") == len(axes)).drop("count")
    return enough.join(here.select(*key, F.col("_a").alias("cell"), F.col("_o").alias("offset_cell")).distinct(), [*key, "cell", "offset_cell"], "left_semi")


def best_two(ranked: DataFrame, key: list[str], score: str, order: list[str]) -> DataFrame:
    """Per key the best candidate's score, the second's, and their margin."""
    w = Window.partitionBy(*key).orderBy(F.desc(score), *order)
    top = ranked.withColumn("_r", F.row_number().over(w)).withColumn("second", F.lead(score).over(w)).filter("_r = 1")
    return top.drop("_r").withColumn("margin", F.col(score) - F.coalesce("second", F.lit(0.0)))
