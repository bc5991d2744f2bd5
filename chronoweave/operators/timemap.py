"""Piecewise-affine time maps: ordered half-open spans of kinds matched, sourceOnly, targetOnly, ambiguous.

Spans: map_id, span_index, kind, source_start_ms, source_end_ms, target_start_ms, target_end_ms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from .intervals import range_join


def project_times(points: DataFrame, spans: DataFrame, t: str = "t_ms", map_id: str = "map_id", width: int = 86_400_000) -> DataFrame:
    """Each point's status (mapped, ambiguous, unmapped), reason, span_index and target_ms.

    An ambiguous span of no source length at the very point comes first; then the span that holds the point;
    then a targetOnly span at the point; else the point is before or after the map (or the map is empty).
    Points need a unique column ``point_id``.
    """
    positive = spans.filter("source_end_ms > source_start_ms").select(map_id, "span_index", "kind", "source_start_ms", "source_end_ms", "target_start_ms", "target_end_ms")
    doubt = spans.filter("kind = 'ambiguous' and source_end_ms = source_start_ms").groupBy(map_id, F.col("source_start_ms").alias(t)).agg(F.min("span_index").alias("doubt_index"))
    extra = spans.filter("kind = 'targetOnly'").groupBy(map_id, F.col("source_start_ms").alias(t)).agg(F.min("span_index").alias("extra_index"))
    begins = spans.groupBy(map_id).agg(F.min_by("source_start_ms", "span_index").alias("map_start_ms"))
    inside = range_join(points.select("point_id", map_id, t), positive, t, "source_start_ms", "source_end_ms", on=[map_id], width=width).drop(map_id, t)
    j = points.join(inside, "point_id", "left").join(doubt, [map_id, t], "left").join(extra, [map_id, t], "left").join(begins, map_id, "left")
    doubtful, held, boundary = F.col("doubt_index").isNotNull(), F.col("span_index").isNotNull(), F.col("extra_index").isNotNull()
    image = X.interpolate(F.col(t), F.col("source_start_ms"), F.col("source_end_ms"), F.col("target_start_ms"), F.col("target_end_ms"))
    matched = ~doubtful & held & (F.col("kind") == "matched")
    return j.select(
        *points.columns,
        F.when(doubtful | (held & (F.col("kind") == "ambiguous")), "ambiguous").when(matched, "mapped").otherwise("unmapped").alias("status"),
        F.when(doubtful | (held & (F.col("kind") == "ambiguous")), "ambiguousSpan")
        .when(matched, F.lit(None).cast("string"))
        .when(held, "sourceOnly")
        .when(boundary, "targetOnlyBoundary")
        .when(F.col("map_start_ms").isNull(), "emptyMap")
        .when(F.col(t) < F.col("map_start_ms"), "beforeMap")
        .otherwise("afterMap")
        .alias("reason"),
        F.when(doubtful, F.col("doubt_index")).when(held, F.col("span_index")).otherwise(F.col("extra_index")).alias("span_index"),
        F.when(matched, image).alias("target_ms"),
    )


def validate(spans: DataFrame, map_id: str = "map_id") -> DataFrame:
    """One row per issue: map_id, span_index, code."""
    w = Window.partitionBy(map_id).orderBy("span_index")
    source, target = F.col("source_end_ms") - F.col("source_start_ms"), F.col("target_end_ms") - F.col("target_start_ms")
    before_source, before_target = F.col("_source"), F.col("_target")
    code = lambda cond, name: F.when(cond, F.lit(name))
    issues = F.array_compact(
        F.array(
            code((source < 0) | (target < 0) | (F.col("source_start_ms") < 0) | (F.col("target_start_ms") < 0), "invalidRange"),
            code((F.col("kind") == "matched") & ((source <= 0) | (target <= 0)), "emptyMatched"),
            code((F.col("kind") == "sourceOnly") & ((source <= 0) | (target != 0)), "badSourceOnly"),
            code((F.col("kind") == "targetOnly") & ((target <= 0) | (source != 0)), "badTargetOnly"),
            code((F.col("kind") == "ambiguous") & (source == 0) & (target == 0), "emptyAmbiguous"),
            code(F.col("source_start_ms") < before_source, "sourceOverlap"),
            code(F.col("source_start_ms") > before_source, "sourceGap"),
            code(F.col("target_start_ms") < before_target, "targetOverlap"),
            code(F.col("target_start_ms") > before_target, "targetGap"),
        )
    )
    lagged = spans.withColumn("_source", F.lag("source_end_ms").over(w)).withColumn("_target", F.lag("target_end_ms").over(w))
    return lagged.select(map_id, "span_index", F.explode(issues).alias("code"))


def legacy_spans(rules: DataFrame, ranges: DataFrame, key: str = "map_id") -> DataFrame:
    """Spans from a start and cumulative gaps: matched stretches, with a targetOnly span where a gap opens.

    ranges: key, source_start_ms, source_end_ms, target_start_ms. rules: key, source_at_ms, gap_ms; those at one
    time add up, zero sums and rules outside the range are left out. From the first negative sum on the rest of
    the range is one ambiguous span.
    """
    sums = rules.join(ranges, key).filter("source_at_ms >= source_start_ms and source_at_ms < source_end_ms").groupBy(key, "source_at_ms").agg(F.sum("gap_ms").alias("gap_ms")).filter("gap_ms != 0")
    first_bad = sums.filter("gap_ms < 0").groupBy(key).agg(F.min("source_at_ms").alias("bad_ms"))
    knots = sums.join(first_bad, key, "left").filter("bad_ms is null or source_at_ms <= bad_ms").select(key, "source_at_ms", F.greatest("gap_ms", F.lit(0)).alias("gap_ms"), (F.col("gap_ms") < 0).alias("bad"))
    starts = ranges.select(key, F.col("source_start_ms").alias("source_at_ms"), F.lit(0).cast("long").alias("gap_ms"), F.lit(False).alias("bad"))
    points = knots.unionByName(starts).groupBy(key, "source_at_ms").agg(F.sum("gap_ms").alias("gap_ms"), F.bool_or("bad").alias("bad")).join(ranges, key)
    w = Window.partitionBy(key).orderBy("source_at_ms")
    shift = F.coalesce(F.sum("gap_ms").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = F.col("target_start_ms") + F.col("source_at_ms") - F.col("source_start_ms") + F.col("shift")
    stop = F.coalesce(F.col("next_ms"), F.col("source_end_ms"))
    cells = points.withColumn("shift", shift).withColumn("next_ms", F.lead("source_at_ms").over(w)).withColumn("at", at).withColumn("stop", stop)
    span = lambda kind, a, b, c, d: F.struct(F.lit(kind).alias("kind"), a.alias("source_start_ms"), b.alias("source_end_ms"), c.alias("target_start_ms"), d.alias("target_end_ms"))
    s, e, g = F.col("source_at_ms"), F.col("stop"), F.col("gap_ms")
    body = F.when(F.col("bad"), span("ambiguous", s, F.col("source_end_ms"), F.col("at"), F.col("at"))).otherwise(span("matched", s, e, F.col("at") + g, F.col("at") + g + e - s))
    parts = F.filter(F.array(F.when((g > 0) & ~F.col("bad"), span("targetOnly", s, s, F.col("at"), F.col("at") + g)), F.when((e > s) | F.col("bad"), body)), lambda x: x.isNotNull())
    made = cells.select(key, F.explode(parts).alias("x")).select(key, "x.*")
    order = Window.partitionBy(key).orderBy("source_start_ms", "target_start_ms", "source_end_ms")
    return made.withColumn("span_index", F.row_number().over(order) - 1)
