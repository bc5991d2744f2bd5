"""Candidates and their time maps over their life: every change gives a new relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What may follow what.
MOVES = {"pending": ("accepted", "rejected", "blocked"), "accepted": ("pending",), "rejected": ("pending",), "blocked": ("pending",)}


def decide(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates after their decisions, one by one in order of ``seq`` (of equals by state): what the state at that time
    does not allow is refused, and counted. Candidates without decisions stay; decisions without a candidate are left out."""
    listed = decisions.groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct("seq", "to_state"))).alias("_d"))
    pair = lambda state, refused: F.struct(state.alias("state"), refused.cast("long").alias("refused"))

    def step(now: Column, d: Column) -> Column:
        ok = F.lit(False)
        for a, bs in MOVES.items():
            ok = ok | ((now["state"] == a) & d["to_state"].isin(*bs))
        ok = F.coalesce(ok, F.lit(False))
        return pair(F.when(ok, d["to_state"]).otherwise(now["state"]), now["refused"] + F.when(ok, 0).otherwise(1))

    none = F.coalesce("_d", F.filter("_d", lambda x: F.lit(False)), F.array().cast(listed.schema["_d"].dataType))
    after = F.aggregate(none, pair(F.col("state"), F.lit(0)), step)
    return candidates.join(listed, "candidate_id", "left").withColumn("_a", after).withColumn("refused", F.col("_a.refused")).withColumn("state", F.col("_a.state")).drop("_a", "_d")


def reconcile(old: DataFrame, new: DataFrame) -> DataFrame:
    """New candidates over old: undecided old ones that did not come again go, decided ones stay as they are."""
    decided = old.filter("state in ('accepted', 'rejected')")
    fresh = new.join(decided.select("candidate_id"), "candidate_id", "left_anti").select(*old.columns)
    return decided.unionByName(fresh)


def supersede(maps: DataFrame) -> DataFrame:
    """Of several confirmed maps of one source and target, the highest revision stays confirmed."""
    n = F.when(F.col("state") == "confirmed", F.row_number().over(Window.partitionBy("source_id", "target_id", "state").orderBy(F.desc("revision"), "map_id")))
    return maps.withColumn("_n", n).withColumn("state", F.when(F.col("_n") > 1, "superseded").otherwise(F.col("state"))).drop("_n")


def shift(spans: DataFrame, source: Column, target: Column) -> DataFrame:
    """All spans moved along both axes."""
    return spans.withColumns({"source_start_ms": F.col("source_start_ms") + source, "source_end_ms": F.col("source_end_ms") + source, "target_start_ms": F.col("target_start_ms") + target, "target_end_ms": F.col("target_end_ms") + target})


def clip_proposal(points: DataFrame, at: str, start: int, end: int) -> DataFrame:
    """Anchors or cuts inside a range; their own ranges, if they have any, cut to it."""
    kept = points.filter(F.col(at).between(start, end))
    for c in ("range_start_ms", "range_end_ms"):
        if c in points.columns:
            kept = kept.withColumn(c, F.least(F.lit(end), F.greatest(F.lit(start), F.col(c))))
    return kept


def split_span(spans: DataFrame, map_id: str, index: int, at: int) -> DataFrame:
    """One span cut at a source time strictly inside it; a matched one is cut on both axes by its own line."""
    from ..functions.exprs import interpolate

    hit = (F.col("map_id") == map_id) & (F.col("span_index") == index) & (F.col("source_start_ms") < at) & (F.col("source_end_ms") > at)
    image = F.when(F.col("kind") == "matched", interpolate(F.lit(at), F.col("source_start_ms"), F.col("source_end_ms"), F.col("target_start_ms"), F.col("target_end_ms"))).otherwise(F.col("target_start_ms"))
    side = lambda a, b, c, d, k: F.struct(a.alias("source_start_ms"), b.alias("source_end_ms"), c.alias("target_start_ms"), d.alias("target_end_ms"), F.lit(k).alias("part"))
    a, b, c, d = (F.col(x) for x in ("source_start_ms", "source_end_ms", "target_start_ms", "target_end_ms"))
    parts = F.when(hit, F.array(side(a, F.lit(at).cast("long"), c, image, 0), side(F.lit(at).cast("long"), b, image, d, 1))).otherwise(F.array(side(a, b, c, d, 0)))
    out = spans.withColumn("_s", F.explode(parts)).select("map_id", "kind", F.col("span_index").alias("_i"), "_s.*")
    return out.withColumn("span_index", F.row_number().over(Window.partitionBy("map_id").orderBy("_i", "part")) - 1).drop("_i", "part")
