"""Placing, filtering and counting timed items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from .intervals import range_join


def resolve(items: DataFrame, clips: DataFrame, steps: DataFrame | None = None, adjustments: DataFrame | None = None, disabled: DataFrame | None = None, global_offset_ms: int = 0) -> DataFrame:
    """Items in every enabled clip of their asset that holds their time, with the time they end up at.

    final = clip start + (time - clip in) + clip offset + item adjustment + global offset, then moved by the sum
    of all step gaps at or before that (not again at the moved time). Items: item_id, asset_id, t_ms,
    original_index, enabled. Clips: clip_id, asset_id, timeline_start_ms, source_in_ms, source_out_ms,
    local_offset_ms, enabled. Steps: source_at_ms, target_gap_ms (one row per knot, a project's few dozen).
    """
    live = clips.filter("enabled").select("clip_id", "asset_id", "timeline_start_ms", "source_in_ms", "source_out_ms", "local_offset_ms")
    hit = range_join(items, live, "t_ms", "source_in_ms", "source_out_ms", on=["asset_id"], width=86_400_000)
    if adjustments is not None:
        hit = hit.join(adjustments.select("item_id", "adjustment_ms"), "item_id", "left")
    else:
        hit = hit.withColumn("adjustment_ms", F.lit(0).cast("long"))
    if disabled is not None:
        hit = hit.join(disabled.select("item_id", F.lit(True).alias("_off")), "item_id", "left").withColumn("enabled", F.col("enabled") & F.col("_off").isNull()).drop("_off")
    raw = F.col("timeline_start_ms") + F.col("t_ms") - F.col("source_in_ms") + F.col("local_offset_ms") + F.coalesce("adjustment_ms", F.lit(0)) + global_offset_ms
    placed = hit.withColumn("raw_ms", raw)
    if steps is not None:
        knots = steps.agg(F.array_sort(F.collect_list(F.struct("source_at_ms", "target_gap_ms"))).alias("_steps"))
        # One row, joined to every item.
        placed = placed.crossJoin(F.broadcast(knots)).withColumn("final_ms", F.col("raw_ms") + X.stepped_offset(F.col("raw_ms"), F.col("_steps"))).drop("_steps")
    else:
        placed = placed.withColumn("final_ms", F.col("raw_ms"))
    return placed


def in_range(events: DataFrame, t: str, start: int, end: int) -> DataFrame:
    """Rows from start to end, both included."""
    return events.filter(F.col(t).between(start, end))


def visible_at(events: DataFrame, now_ms: int, most: int = 80) -> DataFrame:
    """The first ``most`` enabled events on show at ``now_ms``: modes 4 and 5 last 4.5 s, others 8 s."""
    lasts = F.when(F.coalesce(F.col("mode"), F.lit(1)).isin(4, 5), 4500).otherwise(8000)
    shown = events.filter(F.col("enabled") & F.col("final_ms").between(now_ms - 8000, now_ms) & (F.col("final_ms") + lasts >= now_ms))
    return shown.orderBy("final_ms", "original_index").limit(most)


def density(events: DataFrame, t: str, start: int, end: int, size: int) -> DataFrame:
    """Enabled events in each bucket of ``size`` from the one of ``start`` up to ``end``; empty buckets count 0."""
    size = max(1, size)
    first = start // size * size
    n = max(1, -(-(end - first) // size))
    spine = events.sparkSession.range(n).select((F.lit(first) + F.col("id") * size).alias("bucket_ms"))
    counts = events.filter(F.col("enabled") & F.col(t).between(first, end)).groupBy((F.floor(F.col(t) / size) * size).alias("bucket_ms")).agg(F.count("*").alias("n"))
    return spine.join(counts, "bucket_ms", "left").select("bucket_ms", (F.col("bucket_ms") + size).alias("end_ms"), F.coalesce("n", F.lit(0)).alias("n_events"))


def asset_ranges(items: DataFrame, asset: str = "asset_id", t: str = "t_ms") -> DataFrame:
    """First and last time of each asset; the last is 0 at least."""
    return items.groupBy(asset).agg(F.min(t).alias("first_ms"), F.greatest(F.max(t), F.lit(0)).alias("last_ms"), F.count("*").alias("n_items"))


def project_duration(clips: DataFrame, events: DataFrame, media: DataFrame) -> DataFrame:
    """The longest of a minute, the last clip end, the last event, and the media; one row."""
    a = clips.agg(F.max(F.expr("timeline_start_ms + source_out_ms - source_in_ms")).alias("v"))
    b = events.agg(F.max("final_ms").alias("v"))
    c = media.agg(F.max("duration_ms").alias("v"))
    return a.unionByName(b).unionByName(c).agg(F.greatest(F.lit(60_000), F.max("v")).alias("duration_ms"))


def arrange(clips: DataFrame, key: list[str], order: list[str], length: str, least: int = 30_000) -> DataFrame:
    """Clips one after another: each starts where the sum of the earlier lengths (``least`` at least) ends."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return clips.withColumn("timeline_start_ms", F.coalesce(F.sum(F.greatest(F.col(length), F.lit(least))).over(w), F.lit(0)))


def append_offsets(segments: DataFrame, key: list[str], order: list[str], duration: str, fallback: str) -> DataFrame:
    """Running offset of each segment in its episode: the earlier durations, or the last entry time where unknown."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("offset_ms", F.coalesce(F.sum(F.coalesce(F.col(duration), F.col(fallback))).over(w), F.lit(0)))


def split_clips(clips: DataFrame, at: Column) -> DataFrame:
    """Each clip that ``at`` (timeline ms) lies strictly inside becomes two; others stay."""
    cut = F.col("source_in_ms") + at - F.col("timeline_start_ms")
    inside = (cut > F.col("source_in_ms")) & (cut < F.col("source_out_ms"))
    left = F.struct(F.lit(0).alias("part"), F.col("timeline_start_ms").alias("s"), F.col("source_in_ms").alias("i"), F.when(inside, cut).otherwise(F.col("source_out_ms")).alias("o"))
    right = F.struct(F.lit(1).alias("part"), at.cast("long").alias("s"), cut.alias("i"), F.col("source_out_ms").alias("o"))
    parts = F.when(inside, F.array(left, right)).otherwise(F.array(left))
    return clips.withColumn("_p", F.explode(parts)).withColumns({"timeline_start_ms": F.col("_p.s"), "source_in_ms": F.col("_p.i"), "source_out_ms": F.col("_p.o"), "part": F.col("_p.part")}).drop("_p")


def windowed(items: DataFrame, t: str, mode: str, start: int = 0, end: int = 0) -> DataFrame:
    """Items of a window, re-based to its start. prefix: before ``end``; suffix: from ``start``; range: both; full: all."""
    lo, hi = start if mode in ("suffix", "range") else None, end if mode in ("prefix", "range") else None
    kept = items
    if lo is not None:
        kept = kept.filter(F.col(t) >= lo)
    if hi is not None:
        kept = kept.filter(F.col(t) < hi)
    return kept.withColumn("window_ms", F.col(t) - (lo or 0))


def boundary_gaps(items: DataFrame, key: list[str], t: str, boundaries: DataFrame, boundary: str, window: str, least: int = 60_000) -> DataFrame:
    """For each expected boundary of a key the best quiet gap: adjacent times at least ``least`` apart, middle no
    farther than ``window``; best by gap less a fifth of the distance, the earlier of equals."""
    w = Window.partitionBy(*key).orderBy(t)
    gaps = items.select(*key, F.col(t).alias("left_ms"), F.lead(t).over(w).alias("right_ms")).filter(F.col("right_ms") - F.col("left_ms") >= least)
    middle = (F.col("left_ms") + F.col("right_ms")) / 2
    distance = F.abs(middle - F.col(boundary))
    scored = gaps.join(boundaries, key).filter(distance <= F.col(window)).withColumn("score", F.col("right_ms") - F.col("left_ms") - distance * 0.2)
    best = F.max(F.struct("score", (-F.col("left_ms")).alias("l"), F.col("right_ms").alias("r")))
    return scored.groupBy(*key, boundary).agg(best.alias("b")).select(*key, boundary, (-F.col("b.l")).alias("left_ms"), F.col("b.r").alias("right_ms"), F.col("b.score").alias("score"))
