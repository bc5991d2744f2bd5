"""Fingerprint joins, offset votes and local peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X


def hash_join(source: DataFrame, target: DataFrame, vec: str, t: str, frame_id: str, dims: int = 4, steps: int = 32, per_key: int = 32, threshold: float = 0.35) -> DataFrame:
    """Pairs of frames with one quantised key and a small distance. Of a key's targets ``per_key`` evenly spaced
    ones are taken: that is the operator's meaning (it bounds the votes of a common sound), not a shortcut."""
    keyed = target.select(F.col(frame_id).alias("target_id"), F.col(t).alias("target_t"), F.col(vec).alias("target_v"), X.quantised_key(F.col(vec), dims, steps).alias("k"))
    w = Window.partitionBy("k").orderBy("target_t", "target_id")
    ranked = keyed.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy("k")))
    # Slot s of m takes row floor(s n / m), so row i is taken if some s maps to it.
    slot = F.ceil(F.col("_i") * per_key / F.col("_n"))
    sampled = ranked.filter((F.col("_n") <= per_key) | ((slot < per_key) & (F.floor(slot * F.col("_n") / per_key) == F.col("_i")))).drop("_i", "_n")
    left = source.select(F.col(frame_id).alias("source_id"), F.col(t).alias("source_t"), F.col(vec).alias("source_v"), X.quantised_key(F.col(vec), dims, steps).alias("k"))
    joined = left.join(sampled, "k").withColumn("distance", X.rms_distance(F.col("source_v"), F.col("target_v")))
    return joined.filter(F.col("distance") <= threshold).select("source_id", "target_id", "source_t", "target_t", "distance")


def landmark_join(source: DataFrame, target: DataFrame, most: int = 64) -> DataFrame:
    """Landmarks (hash, time_ms) of one family (hash without its last byte) whose last bytes differ by 1 at most.
    Families of more than ``most`` on either side say nothing and are left out, as the operator is defined."""
    side = lambda df, p: df.select(F.shiftright("hash", 8).alias("family"), (F.col("hash").bitwiseAND(255)).alias(f"{p}_bucket"), F.col("time_ms").alias(f"{p}_ms"))
    s, t = side(source, "source"), side(target, "target")
    few = lambda df: df.groupBy("family").count().filter(F.col("count") <= most).select("family")
    kept = few(s).join(few(t), "family")
    return s.join(kept, "family").join(t, "family").filter(F.abs(F.col("source_bucket") - F.col("target_bucket")) <= 1).select("family", "source_ms", "target_ms", (F.col("target_ms") - F.col("source_ms")).alias("offset_ms"))


def offset_votes(pairs: DataFrame, offset: str, step: int = 1_000, top: int = 24, sure: int = 8) -> DataFrame:
    """Votes per rounded offset: the ``top`` of them by count, those with two votes or among the first ``sure``."""
    counts = pairs.groupBy((X.round_half_up(F.col(offset) / step) * step).alias("offset_ms")).agg(F.count("*").alias("votes"))
    best = counts.orderBy(F.desc("votes"), "offset_ms").limit(top)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("votes"), "offset_ms")))  # ``top`` rows
    return ranked.filter((F.col("votes") >= 2) | (F.col("rank") <= sure))


def landmark_hash(first_bin: str, second_bin: str, delta_ms: str):  # noqa: ANN201
    """Two frequency bins and a time difference in steps of 50 ms in 24 bits."""
    return F.shiftleft(F.col(first_bin).bitwiseAND(255), 16).bitwiseOR(F.shiftleft(F.col(second_bin).bitwiseAND(255), 8)).bitwiseOR(F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col(delta_ms) + 25) / 50))).cast("int"))


def peaks(cells: DataFrame, key: list[str], frame: str, band: str, value: str, factor: float = 2.25, per_frame: int = 4) -> DataFrame:
    """Local maxima in time and frequency above ``factor`` times their frame's mean; the strongest ``per_frame``."""
    along = Window.partitionBy(*key, band).orderBy(frame)
    across = Window.partitionBy(*key, frame).orderBy(band)
    whole = Window.partitionBy(*key, frame)
    v = F.col(value)
    around = [f(value).over(w) for f in (F.lag, F.lead) for w in (along, across)]
    is_peak = v >= factor * F.avg(value).over(whole)
    for n in around:
        is_peak = is_peak & (n.isNull() | (v > n))
    found = cells.withColumn("_p", is_peak).filter("_p").drop("_p")
    return found.withColumn("rank", F.row_number().over(whole.orderBy(F.desc(value), band))).filter(F.col("rank") <= per_frame)


def energy_centroids(landmarks: DataFrame, key: list[str], t: str, band: str, strength: str, width: int = 500) -> DataFrame:
    """Per window: weighted mean band, activity and strength, weights ln(1 + strength)."""
    w = F.log1p(F.col(strength))
    return landmarks.groupBy(*key, F.floor(F.col(t) / width).alias("frame")).agg((F.sum(w * F.col(band)) / F.sum(w)).alias("centroid"), F.count("*").alias("activity"), F.sum(w).alias("energy"))
