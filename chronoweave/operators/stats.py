"""Evaluation statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Buckets of a key's values among which a percentile is first sought.
BUCKETS = 1 << 14


def nearest_rank(df: DataFrame, key: list[str], value: str, ps: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Nearest-rank percentiles (index ceil(p n) - 1), maximum and count.

    Rows are counted in buckets of equal width between a key's least and greatest value; only the values of the buckets that
    hold a rank are then counted one by one. No list or map of a key's values is held."""
    v = F.col(value).cast("double")
    finite = F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v / 2)  # halves, so that no difference overflows
    known = df.select(*key, value)
    whole = known.groupBy(*key).agg(F.max(value).alias("max_value"), F.count(value).alias("n"), F.min(finite).alias("_low"), F.max(finite).alias("_high"))
    same = lambda a, b, columns: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns]
    bounds = whole.select(*key, "_low", (F.col("_high") - F.col("_low")).alias("_wide"))
    place = F.coalesce(F.floor((v / 2 - F.col("_low")) / F.nullif("_wide", F.lit(0.0)) * BUCKETS), F.lit(0))
    bucket = F.when(F.isnan(v), BUCKETS + 2).when(v == float("inf"), BUCKETS + 1).when(v == float("-inf"), -1).otherwise(place).cast("long")
    placed = known.filter(F.col(value).isNotNull()).alias("r").join(F.broadcast(bounds).alias("b"), same("r", "b", key)).select(*[F.col(f"r.{c}") for c in (*key, value)], bucket.alias("_bucket"))
    w = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    upto = placed.groupBy(*key, "_bucket").agg(F.count("*").alias("_c")).withColumn("_upto", F.sum("_c").over(w))
    ranks = whole.filter("n > 0").select(*key, F.posexplode(F.array(*[F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(float(p)))).cast("long") for p in ps])).alias("_p", "_rank"))
    held = (F.col("_rank") > F.col("u._upto") - F.col("u._c")) & (F.col("_rank") <= F.col("u._upto"))
    sought = upto.alias("u").join(F.broadcast(ranks).alias("k"), [*same("u", "k", key), held])
    sought = sought.select(*[F.col(f"u.{c}") for c in (*key, "_bucket")], "_p", (F.col("_rank") - F.col("u._upto") + F.col("u._c")).alias("_rank"))
    full = [*key, "_bucket"]
    few = placed.alias("r").join(F.broadcast(sought.select(*full).distinct()).alias("s"), same("r", "s", full), "left_semi").groupBy(*full, value).agg(F.count("*").alias("_c"))
    counted = few.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*full).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    at = counted.alias("c").join(F.broadcast(sought).alias("s"), [*same("c", "s", full), F.col("c._upto") >= F.col("s._rank")])
    found = at.groupBy(*[F.col(f"c.{c}") for c in key]).agg(*[F.min(F.when(F.col("_p") == i, F.col(f"c.{value}"))).alias(f"p{round(p * 100)}") for i, p in enumerate(ps)])
    names = [f"p{round(p * 100)}" for p in ps]
    out = whole.alias("w").join(F.broadcast(found).alias("f"), same("w", "f", key), "left") if key else whole.alias("w").crossJoin(found.alias("f"))
    return out.select(*[F.col(f"w.{c}") for c in key], *[F.col(f"f.{c}") for c in names], "max_value", "n")


def ceil_rank(df: DataFrame, key: list[str], value: str, q: float, alias: str) -> DataFrame:
    """The other convention: index ceil((n - 1) q). Counts of distinct values are summed up to the rank, so a key's
    rows meet as counts, not as a list."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*key)
    rank = counts.withColumn("_n", F.sum("_c").over(w)).withColumn("_upto", F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    return rank.filter(F.col("_upto") > F.ceil((F.col("_n") - 1) * F.lit(q))).groupBy(*key).agg(F.min(value).alias(alias))


def precision_recall(df: DataFrame, key: list[str], gold: Column, predicted: Column, empty: float = 1.0) -> DataFrame:
    """True and false positives, false negatives, precision, recall and F1. ``empty`` is what a zero denominator gives:
    1 for component metrics, 0 for acceptance metrics."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    ratio = lambda a, b: F.when(b == 0, F.lit(float(empty))).otherwise(a / b)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    counted = df.groupBy(*key).agg(n(gold & predicted).alias("tp"), n(~gold & predicted).alias("fp"), n(gold & ~predicted).alias("fn"))
    rated = counted.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    return rated.withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, F.lit(0.0)).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def calibration_bins(df: DataFrame, probability: str, outcome: Column, bins: int = 10) -> DataFrame:
    """Equal-width bins (the last one closed): count, mean probability, share of positives, gap."""
    b = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).alias("bin")
    return df.groupBy(b).agg(F.count("*").alias("n"), F.avg(probability).alias("confidence"), F.avg(outcome.cast("double")).alias("accuracy")).withColumn("gap", F.abs(F.col("confidence") - F.col("accuracy")))


def calibration_error(binned: DataFrame) -> DataFrame:
    """Expected calibration error of the bins; one row."""
    return binned.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def brier(df: DataFrame, probability: str, outcome: Column) -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(probability) - outcome.cast("double"), F.lit(2))).alias("brier"))


def topk_accuracy(ranked: DataFrame, key: str, rank: str, hit: Column, ks: tuple[int, ...] = (1, 3, 10)) -> DataFrame:
    """Share of keys with a hit among their first k; keys without any rank count as misses. One row."""
    first = ranked.groupBy(key).agg(F.min(F.when(hit, F.col(rank))).alias("_r"))
    return first.agg(F.count("*").alias("n"), *[F.avg(F.when(F.col("_r") <= k, 1.0).otherwise(0.0)).alias(f"top{k}") for k in ks])


def affine_fit(df: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
    """Least-squares slope and intercept (null without two different x)."""
    return df.groupBy(*key).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n"))


def weighted_mean(scores: list[tuple[Column, float]]) -> Column:
    """Sum of score times weight over the sum of the weights of scores that are known."""
    top = sum((F.coalesce(s * w, F.lit(0.0)) for s, w in scores), F.lit(0.0))
    low = sum((F.when(s.isNotNull(), F.lit(float(w))).otherwise(F.lit(0.0)) for s, w in scores), F.lit(0.0))
    return F.when(low > 0, top / low)


def peak(values: Column) -> Column:
    """Maximum, or null if any value is null."""
    return F.when(F.count_if(values.isNull()) == 0, F.max(values))
