"""Order-dependent operators over sequences. Windows that look a fixed number of rows around are native; folds whose
state depends on what they kept run per sequence, over one sequence at a time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import runs


def gap_steps(df: DataFrame, key: list[str], order: list[str], source: str, target: str, least: int = 1_000) -> DataFrame:
    """Where target - source grows by ``least`` or more from one row to the next: the place and the growth."""
    w = Window.partitionBy(*key).orderBy(*order)
    gap = F.col(target) - F.col(source)
    stepped = df.withColumn("gap_ms", gap).withColumn("step_ms", F.col("gap_ms") - F.lag("gap_ms").over(w)).withColumn("previous_ms", F.lag(source).over(w))
    return stepped.filter(F.col("step_ms") >= least)


def moving_median(df: DataFrame, key: list[str], order: list[str], value: str, reach: int = 2, alias: str = "median") -> DataFrame:
    """Upper median of the rows within ``reach``; fewer at the ends."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(-reach, reach)
    sorted_ = F.array_sort(F.collect_list(value).over(w))
    return df.withColumn("_s", sorted_).withColumn(alias, F.element_at("_s", (F.floor(F.size("_s") / 2) + 1).cast("int"))).drop("_s")


def stabilise(df: DataFrame, key: list[str], order: list[str], offset: str, step: int, least: int, count: int = 5, times: int = 3, share: float = 0.7) -> DataFrame:
    """Offsets with hysteresis: a jump of ``least`` or more forward is taken only if enough of the next
    ``count * times`` rows agree within a step; a jump back never is. One sequence is folded at a time."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        v = ((pdf[offset] / step + 0.5) // 1 * step).astype("int64").to_numpy()
        out, active, n = [], int(v[0]), len(v)
        for i, x in enumerate(v):
            if x - active >= least:
                ahead = v[i : i + count * times]
                need = max(min(count, len(ahead)), -int(-len(ahead) * share // 1))
                if (abs(ahead - x) <= step).sum() >= need:
                    active = int(x)
            out.append(active)
        return pdf.assign(stable=out)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "stable long"])
    return df.groupBy(*key).applyInPandas(fold, schema)


def segments(df: DataFrame, key: list[str], order: list[str], t: str, value: str, distance: str) -> DataFrame:
    """Runs of equal value: first and last time, number of rows, mean distance."""
    r = runs(df, key, order, value)
    return r.groupBy(*key, "run").agg(F.min(t).alias("start_ms"), F.max(t).alias("end_ms"), F.first(value).alias("offset_ms"), F.count("*").alias("n_rows"), F.avg(distance).alias("mean_distance"))


def change_points(segs: DataFrame, key: list[str], least: int, step: int, stable: int = 10_000, count: int = 5) -> DataFrame:
    """Steps up of ``least`` or more between neighbouring segments whose later one lasts long enough."""
    w = Window.partitionBy(*key).orderBy("run")
    d = segs.withColumn("gap_ms", F.col("offset_ms") - F.lag("offset_ms").over(w)).withColumn("before_ms", F.lag("end_ms").over(w))
    span = F.greatest(F.lit(step), F.col("end_ms") - F.col("start_ms") + step)
    return d.filter((F.col("gap_ms") >= least) & (span >= max(stable, step * count))).select(*key, F.floor((F.col("before_ms") + F.col("start_ms")) / 2 + 0.5).alias("at_ms"), "gap_ms", F.col("n_rows").alias("support"))


def merge_near(df: DataFrame, key: list[str], t: str, gap: str, confidence: str, within: int = 2_000) -> DataFrame:
    """Groups whose members lie within ``within`` of the group's first: sum of gaps, lowest confidence, range.
    The group's anchor decides, so this is a fold over the sorted list of one key."""
    acc = "array<struct<a:bigint,z:bigint,g:bigint,c:double>>"
    rows = df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(t).cast("long").alias("t"), F.col(gap).cast("long").alias("g"), F.col(confidence).cast("double").alias("c")))).alias("r"))

    def step(groups, x):  # noqa: ANN001, ANN202
        last = F.element_at(groups, -1)
        one = F.array(F.struct(x["t"].alias("a"), x["t"].alias("z"), x["g"].alias("g"), x["c"].alias("c")))
        joined = F.array(F.struct(last["a"].alias("a"), x["t"].alias("z"), (last["g"] + x["g"]).alias("g"), F.least(last["c"], x["c"]).alias("c")))
        return F.when((F.size(groups) > 0) & (x["t"] - F.try_element_at(groups, F.lit(-1))["a"] <= within), F.concat(F.slice(groups, 1, F.greatest(F.size(groups) - 1, F.lit(0))), joined.cast(acc))).otherwise(F.concat(groups, one.cast(acc)))

    folded = rows.select(*key, F.explode(F.aggregate("r", F.array().cast(acc), step)).alias("m"))
    return folded.select(*key, F.col("m.a").alias("start_ms"), F.col("m.z").alias("end_ms"), F.col("m.g").alias("gap_ms"), F.col("m.c").alias("confidence"))


def increasing(df: DataFrame, key: list[str], source: str, target: str, residual: str) -> DataFrame:
    """Best row for each source (least residual, then least target), then those whose target exceeds all earlier ones."""
    best = df.groupBy(*key, source).agg(F.min(F.struct(F.col(residual), F.col(target))).alias("b")).select(*key, source, F.col(f"b.{target}").alias(target), F.col(f"b.{residual}").alias(residual))
    w = Window.partitionBy(*key).orderBy(source).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(target).over(w)
    return best.withColumn("_reach", reach).filter(F.col("_reach").isNull() | (F.col(target) > F.col("_reach"))).drop("_reach")


def playback(df: DataFrame, key: list[str], wall: str, media: str, most_gap: int = 750, rate: float = 1.35, jitter: int = 120) -> DataFrame:
    """Plausible playback between consecutive observations: wall gap and media advance within bounds."""
    w = Window.partitionBy(*key).orderBy(wall)
    d = df.withColumn("wall_gap", F.col(wall) - F.lag(wall).over(w)).withColumn("media_gap", F.col(media) - F.lag(media).over(w))
    status = F.when(F.col("wall_gap").isNull(), "first").when(F.col("wall_gap") > most_gap, "gap").when(F.col("media_gap") < 0, "seekBack").when(F.col("media_gap") == 0, "stalled").when(F.col("media_gap") > F.col("wall_gap") * rate + jitter, "jump").otherwise("playing")
    return d.withColumn("status", status)
