"""Project documents (one JSON object each) to relations and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CURRENT = 13
SCHEMA = """schemaVersion int, id string, globalOffsetMs long,
 clips array<struct<id:string,assetId:string,name:string,timelineStartMs:long,sourceInMs:long,sourceOutMs:long,localOffsetMs:long,enabled:boolean>>,
 cutMarkers array<struct<id:string,sourceAtMs:long,targetGapMs:long>>,
 syncAnchors array<struct<id:string,sourceMs:long,targetMs:long,confidence:double>>,
 disabledItemIds array<string>, itemTimeAdjustments map<string,long>,
 mediaTimeMaps array<struct<id:string,state:string,sourceMediaId:string,targetMediaId:string,spans:array<struct<kind:string,sourceStartMs:long,sourceEndMs:long,targetStartMs:long,targetEndMs:long>>>>"""


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path, wholetext=True))


def parse(texts: DataFrame, column: str = "value") -> DataFrame:
    """One row per document, brought to the current version; what is no such object or from the future is an error row."""
    p = texts.select(F.from_json(column, SCHEMA).alias("p")).select("p.*")
    version = F.coalesce("schemaVersion", F.lit(0))
    error = F.when(F.col("id").isNull(), "notAProject").when(version > CURRENT, "newerVersion").when(version < 1, "badVersion")
    # Up to version 1 clips were closed ranges.
    opened = F.transform("clips", lambda c: c.withField("sourceOutMs", c["sourceOutMs"] + F.when(version < 2, 1).otherwise(0)))
    return p.withColumn("error", error).withColumn("clips", opened).withColumn("globalOffsetMs", F.coalesce("globalOffsetMs", F.lit(0))).withColumn("schemaVersion", F.when(error.isNull(), CURRENT).otherwise(F.col("schemaVersion")))


def _rows(p: DataFrame, column: str) -> DataFrame:
    return p.filter("error is null").select(F.col("id").alias("project_id"), F.explode(column).alias("x")).select("project_id", "x.*")


def clips(p: DataFrame) -> DataFrame:
    return _rows(p, "clips").select("project_id", F.col("id").alias("clip_id"), F.col("assetId").alias("asset_id"), F.col("timelineStartMs").alias("timeline_start_ms"), F.col("sourceInMs").alias("source_in_ms"), F.col("sourceOutMs").alias("source_out_ms"), F.coalesce("localOffsetMs", F.lit(0)).alias("local_offset_ms"), F.coalesce("enabled", F.lit(True)).alias("enabled"))


def steps(p: DataFrame) -> DataFrame:
    return _rows(p, "cutMarkers").select("project_id", F.col("sourceAtMs").alias("source_at_ms"), F.col("targetGapMs").alias("target_gap_ms"))


def adjustments(p: DataFrame) -> DataFrame:
    return p.filter("error is null").select(F.col("id").alias("project_id"), F.explode("itemTimeAdjustments").alias("item_id", "adjustment_ms"))


def disabled(p: DataFrame) -> DataFrame:
    return p.filter("error is null").select(F.col("id").alias("project_id"), F.explode("disabledItemIds").alias("item_id"))


def spans(p: DataFrame) -> DataFrame:
    maps = _rows(p, "mediaTimeMaps").select("project_id", F.col("id").alias("map_id"), "state", F.posexplode("spans").alias("span_index", "s"))
    return maps.select("project_id", "map_id", "state", "span_index", F.col("s.kind").alias("kind"), F.col("s.sourceStartMs").alias("source_start_ms"), F.col("s.sourceEndMs").alias("source_end_ms"), F.col("s.targetStartMs").alias("target_start_ms"), F.col("s.targetEndMs").alias("target_end_ms"))


def serialise(p: DataFrame) -> DataFrame:
    return p.filter("error is null").select("id", F.to_json(F.struct(*[c for c in p.columns if c != "error"])).alias("value"))
