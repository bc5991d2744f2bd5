"""Projection of many sources to many targets through time maps, with every item accounted for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import overlap_pairs, range_join
from .timemap import project_times


def segment_overlaps(segments: DataFrame, width: int = 86_400_000) -> DataFrame:
    """Conflicting pairs: an ignored segment with any other of the same asset and source, or two content segments
    of one target."""
    conflict = (F.col("a.kind") == "ignored") | (F.col("b.kind") == "ignored") | (F.col("a.target_id") == F.col("b.target_id"))
    return overlap_pairs(segments, ["asset_id", "source_id"], "segment_id", "source_start_ms", "source_end_ms", width, conflict)


def segment_states(segments: DataFrame, bindings: DataFrame, media: DataFrame, maps: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Each segment with the first reason that blocks it, or null: overlap, asset not bound to the source, no
    target, no map, map not confirmed, map of other media."""
    pairs = overlaps.select(F.col("left_id").alias("segment_id")).union(overlaps.select("right_id")).distinct().withColumn("overlaps", F.lit(True))
    source = media.select(F.col("media_id").alias("source_id"), F.lit(True).alias("source_known"))
    target = media.select(F.col("media_id").alias("target_id"), F.col("role").alias("target_role"))
    m = maps.select("map_id", F.col("state").alias("map_state"), F.col("source_id").alias("map_source"), F.col("target_id").alias("map_target"))
    j = segments.join(pairs, "segment_id", "left").join(bindings.select("asset_id", F.col("source_id").alias("bound_id")), "asset_id", "left").join(source, "source_id", "left").join(target, "target_id", "left").join(m, "map_id", "left")
    content = F.col("kind") == "content"
    reason = (
        F.when(F.col("overlaps"), "overlap")
        .when(F.col("source_end_ms") <= F.col("source_start_ms"), "emptyRange")
        .when(F.col("bound_id").isNull(), "assetNotBound")
        .when(F.col("bound_id") != F.col("source_id"), "otherSource")
        .when(F.col("source_known").isNull(), "unknownSource")
        .when(content & F.col("target_role").isNull(), "unknownTarget")
        .when(content & (F.col("target_role") != "target"), "notATarget")
        .when(content & F.col("map_id").isNull(), "noTimeMap")
        .when(content & F.col("map_state").isNull(), "unknownTimeMap")
        .when(content & (F.col("map_state") != "confirmed"), "timeMapNotConfirmed")
        .when(content & ((F.col("map_source") != F.col("source_id")) | (F.col("map_target") != F.col("target_id"))), "timeMapOfOtherMedia")
    )
    return j.select(*segments.columns, reason.alias("blocker"))


def project(items: DataFrame, usable: DataFrame, spans: DataFrame, adjustments: DataFrame | None = None, width: int = 86_400_000) -> DataFrame:
    """One row per item and usable content segment that holds it: status, and final_ms where it is mapped."""
    segments = usable.filter("kind = 'content' and blocker is null").select("segment_id", "asset_id", "target_id", "map_id", "source_start_ms", "source_end_ms")
    hits = range_join(items, segments, "t_ms", "source_start_ms", "source_end_ms", on=["asset_id"], width=width).drop("source_start_ms", "source_end_ms")
    hits = hits.withColumn("point_id", F.concat_ws("|", "segment_id", "item_id"))
    placed = project_times(hits, spans, "t_ms", "map_id", width).drop("point_id")
    if adjustments is None:
        return placed.withColumn("final_ms", F.col("target_ms"))
    return placed.join(adjustments, "item_id", "left").withColumn("final_ms", F.col("target_ms") + F.coalesce("adjustment_ms", F.lit(0))).drop("adjustment_ms")


def account(items: DataFrame, projected: DataFrame, usable: DataFrame, width: int = 86_400_000) -> DataFrame:
    """One row of counters. Every item is mapped (projected or disabled), source-only, ignored or unexpectedly
    unmapped; one that is mapped anywhere is never source-only."""
    ignored = usable.filter("kind = 'ignored' and blocker is null").select("asset_id", "source_start_ms", "source_end_ms")
    by_item = projected.groupBy("item_id").agg(F.bool_or(F.col("status") == "mapped").alias("mapped"), F.bool_or(F.col("status") == "unmapped").alias("left_out"), F.sum(((F.col("status") == "mapped") & F.col("enabled")).cast("long")).alias("entries"), F.sum(((F.col("status") == "mapped") & ~F.col("enabled")).cast("long")).alias("off"))
    skipped = range_join(items.select("item_id", "asset_id", "t_ms"), ignored, "t_ms", "source_start_ms", "source_end_ms", on=["asset_id"], width=width).select("item_id").distinct().withColumn("ignored", F.lit(True))
    j = items.select("item_id").join(by_item, "item_id", "left").join(skipped, "item_id", "left")
    mapped, out, ign = F.coalesce("mapped", F.lit(False)), F.coalesce("left_out", F.lit(False)), F.coalesce("ignored", F.lit(False))
    n = lambda c: F.count_if(c)
    return j.agg(
        F.count("*").alias("n_items"),
        F.coalesce(F.sum("entries"), F.lit(0)).alias("projected"),
        F.coalesce(F.sum("off"), F.lit(0)).alias("disabled"),
        n(mapped).alias("mapped_items"),
        n(~mapped & out).alias("source_only"),
        n(ign).alias("ignored"),
        n(~mapped & ~out & ~ign).alias("unexpected_unmapped"),
    )


def target_groups(projected: DataFrame, media: DataFrame) -> DataFrame:
    """Per target: entries, range, disabled, entries before 0 and at or past the target's end (these block export)."""
    live = (F.col("status") == "mapped") & F.col("enabled")
    t = F.when(live, F.col("final_ms"))
    j = projected.join(media.select(F.col("media_id").alias("target_id"), "duration_ms"), "target_id", "left")
    return j.groupBy("target_id").agg(F.count_if(live).alias("n_entries"), F.min(t).alias("first_ms"), F.max(t).alias("last_ms"), F.count_if((F.col("status") == "mapped") & ~F.col("enabled")).alias("n_disabled"), F.count_if(t < 0).alias("n_negative"), F.count_if(t >= F.col("duration_ms")).alias("n_overflow"))
