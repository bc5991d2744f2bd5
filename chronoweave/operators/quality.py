"""Checks of relations: duplicates, orphans, empties, and the scores built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, key: list[str], label: str) -> DataFrame:
    """Keys that occur more than once: how often, and their first and last label."""
    return df.groupBy(*key).agg(F.count("*").alias("n"), F.min(label).alias("first_label"), F.max(label).alias("last_label")).filter("n > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key no parent has; null keys too."""
    return child.join(parent.select(F.col(parent_key).alias("_k")).distinct(), F.col(child_key) == F.col("_k"), "left_anti")


def with_child(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    return parent.join(child.select(F.col(child_key).alias("_k")), F.col(parent_key) == F.col("_k"), "left_semi")


def health(checks: list[tuple[str, DataFrame]]) -> DataFrame:
    """One row for each named check: the number of rows that it found."""
    out = None
    for name, df in checks:
        row = df.agg(F.count("*").alias("n_found")).select(F.lit(name).alias("check"), "n_found")
        out = row if out is None else out.unionByName(row)
    return out


def distinct_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key: its first by ``order``. Folded before the shuffle, so a hot key is one row a task."""
    rest = [c for c in df.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*key).agg(first).select(*key, "_r.*")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``new`` replaces rows of ``old`` with equal keys; the rest of both stays."""
    return old.join(new.select(*key), key, "left_anti").select(*new.columns).unionByName(new)


def compare(left: DataFrame, right: DataFrame, key: list[str], value: str, within: float) -> DataFrame:
    """Rows that only one side has, or whose values are more than ``within`` apart; a null value is equal to a null one only."""
    side = lambda df, name: df.select(*key, F.col(value).alias(name), F.lit(True).alias(f"_{name}"))
    j = side(left, "a").join(side(right, "b"), key, "full_outer")
    apart = F.coalesce(F.abs(F.col("a") - F.col("b")) > within, ~F.col("a").eqNullSafe(F.col("b")))
    status = F.when(F.col("_b").isNull(), "missingRight").when(F.col("_a").isNull(), "missingLeft").when(apart, "differs").otherwise("equal")
    return j.withColumn("status", status).filter("status != 'equal'").drop("_a", "_b")


def conclusion(score: Column, blocked: Column) -> Column:
    return F.when(blocked, "blocked").when(score >= 0.8, "recommended").when(score >= 0.6, "review").otherwise("weak")
