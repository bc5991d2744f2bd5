"""Text hints over time: keyword rules, clusters in windows, and what lies near them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import near_exists

# The built-in rules' labels, patterns and weights.
CUT_RULES = [
    ("删了", "删了|删掉|删减|被删|删过|删了一段|删没了|删掉了", 3),
    ("剪了", "剪了|剪掉|剪辑|剪过|剪没了|被剪|剪掉了", 3),
    ("跳了", "跳了|跳过|怎么跳|突然跳|跳剧情|跳了一段", 2),
    ("和谐", "和谐|河蟹|阉割|被砍|砍了", 3),
    ("没了", "没了|少了|缺了|不见了|中间没|少一段", 2),
]


def keyword_rules(text: str, weight: int = 2) -> list[tuple[str, str, int]]:
    """Rules from a user's list of words (white space, commas, semicolons or bars between them), case ignored."""
    import re

    found = dict.fromkeys(w for w in re.split(r"[\s,，、;；|]+", text) if w)
    return [(w, "(?i)" + re.escape(w), weight) for w in found]


def matched_rules(text: Column, rules: list[tuple[str, str, int]]) -> tuple[Column, Column]:
    """(labels of the rules a text meets, sum of their weights)."""
    hit = [(label, text.rlike(pattern), weight) for label, pattern, weight in rules]
    labels = F.array_compact(F.array(*[F.when(h, F.lit(label)) for label, h, _ in hit]))
    total = sum((F.when(h, F.lit(w)).otherwise(F.lit(0)) for _, h, w in hit[1:]), F.when(hit[0][1], F.lit(hit[0][2])).otherwise(F.lit(0)))
    return labels, total.cast("long")


def clusters(items: DataFrame, rules: list[tuple[str, str, int]], window_ms: int = 60_000, least: int = 2, samples: int = 3, asset: str = "asset_id", t: str = "t_ms", text: str = "text", index: str = "original_index", item_id: str = "item_id") -> DataFrame:
    """Hits of an asset in one window: upper median time, range, number, score, confidence, keywords in order of
    appearance, first texts. Only rows that meet a rule are shuffled; the lists hold one window of one asset.
    """
    labels, score = matched_rules(F.col(text), rules)
    hits = items.withColumn("_k", labels).withColumn("_s", score).filter(F.size("_k") > 0)
    group = hits.groupBy(asset, F.floor(F.col(t) / window_ms).alias("bucket")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), F.col(index).alias("i"), F.col(text).alias("x"), F.col("_k").alias("k"), F.col(item_id).alias("id")))).alias("h"),
        F.count("*").alias("hit_count"),
        F.sum("_s").alias("score"),
    )
    n, s = F.col("hit_count"), F.col("score")
    return group.filter(n >= least).select(
        asset,
        "bucket",
        F.element_at("h", (F.floor(n / 2) + 1).cast("int"))["t"].alias("source_at_ms"),
        F.element_at("h", 1)["t"].alias("start_ms"),
        F.element_at("h", -1)["t"].alias("end_ms"),
        "hit_count",
        "score",
        F.when((n >= 5) | (s >= 12), "high").when((n >= 3) | (s >= 7), "medium").otherwise("low").alias("confidence"),
        F.array_distinct(F.flatten(F.col("h.k"))).alias("keywords"),
        F.slice(F.col("h.x"), 1, samples).alias("sample_texts"),
        F.col("h.id").alias("item_ids"),
    )


def top(found: DataFrame, most: int = 12) -> DataFrame:
    """The report's first ``most`` clusters: highest score, then earliest."""
    return found.orderBy(F.desc("score"), "source_at_ms", *[c for c in ("asset_id", "bucket") if c in found.columns]).limit(most)


def applied(found: DataFrame, markers: DataFrame, within: int = 5_000) -> DataFrame:
    """Clusters that a marker already stands for."""
    return near_exists(found, markers, "source_at_ms", "marker_ms", within)


def boosted(cuts: DataFrame, hints: DataFrame, t: str, hint_t: str, confidence: str, within: int = 45_000, by: float = 0.03, most: float = 0.98) -> DataFrame:
    """Cut candidates with their confidence raised where a hint lies near (each once, 0.98 at most)."""
    near = near_exists(cuts, hints, t, hint_t, within)
    far = near_exists(cuts, hints, t, hint_t, within, how="left_anti")
    raised = near.withColumn(confidence, F.least(F.lit(most), F.col(confidence) + by)).withColumn("supported", F.lit(True))
    return raised.unionByName(far.withColumn("supported", F.lit(False)))
