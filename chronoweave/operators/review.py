"""What a reviewer sees: what is applied already, what comes first, and how good the evidence is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most media on either side of a tile of pairs.
TILE = 256


def applied_anchors(proposed: DataFrame, anchors: DataFrame) -> DataFrame:
    """Proposed anchors that exist: equal source_ms and target_ms."""
    return proposed.join(anchors.select("source_ms", "target_ms").distinct(), ["source_ms", "target_ms"], "left_semi")


def applied_cuts(candidates: DataFrame, markers: DataFrame) -> DataFrame:
    """Cut candidates that a marker has: rounded place (0 at least) and rounded gap."""
    rounded = lambda c: F.floor(F.col(c) + 0.5)
    held = markers.select(F.col("source_at_ms").alias("_at"), F.col("target_gap_ms").alias("_gap")).distinct()
    return candidates.join(held, (F.greatest(F.lit(0), rounded("source_at_ms")) == F.col("_at")) & (rounded("target_gap_ms") == F.col("_gap")), "left_semi")


def selected(events: DataFrame, start: int, end: int, t: str = "final_ms") -> DataFrame:
    """Distinct item_ids of enabled events between two times in either order, both included."""
    return events.filter(F.col("enabled") & F.col(t).between(min(start, end), max(start, end))).select("item_id").distinct()


def pair_plan(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Every source with every target, in tiles of TILE by TILE: source_id, target_id, tile_row, tile_column. All pairs
    are what is asked for; a batch has some hundred media."""
    number = lambda df, c: df.select(F.col(c), (F.floor((F.row_number().over(Window.orderBy(c)) - 1) / TILE)).alias("tile"))
    return number(sources.distinct(), "source_id").withColumnRenamed("tile", "tile_row").crossJoin(number(targets.distinct(), "target_id").withColumnRenamed("tile", "tile_column"))


def checked_pairs(pairs: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Explicit pairs with the reason why one does not do: unknownMedia, duplicate (not the first by place), or null."""
    trimmed = pairs.withColumn("source_id", F.trim("source_id")).withColumn("target_id", F.trim("target_id"))
    known = trimmed.join(sources.select("source_id", F.lit(True).alias("_s")).distinct(), "source_id", "left").join(targets.select("target_id", F.lit(True).alias("_t")).distinct(), "target_id", "left")
    nth = F.row_number().over(Window.partitionBy("source_id", "target_id").orderBy("place"))
    return known.select("place", "source_id", "target_id", F.when(F.col("_s").isNull() | F.col("_t").isNull(), "unknownMedia").when(nth > 1, "duplicate").alias("problem"))


def review_queue(queue: DataFrame) -> DataFrame:
    """``queue`` with its place: blocked, then attention, then all else; source_at_ms, kind and id."""
    rank = F.when(F.col("severity") == "blocked", 0).when(F.col("severity") == "attention", 1).otherwise(2)
    return queue.withColumn("place", F.row_number().over(Window.orderBy(rank, "source_at_ms", "kind", "id")))


def numeric_key(label: Column) -> Column:
    """A key under which labels sort with numbers by value: runs of digits are padded to 20; longer ones come after these, by
    their length."""
    plain = lambda x: F.regexp_replace(x, r"^0+(?=\d)", "")
    longer = lambda x: F.concat(F.lit("~"), F.lpad(F.length(x).cast("string"), 9, "0"), x)
    number = lambda x: F.when(F.length(plain(x)) <= 20, F.lpad(plain(x), 20, "0")).otherwise(longer(plain(x)))
    return F.array_join(F.transform(F.regexp_extract_all(label, F.lit(r"(\d+|\D+)"), 1), lambda x: F.when(x.rlike(r"^\d"), number(x)).otherwise(x)), "")


def low_confidence_regions(matched: Column, frames: Column) -> Column:
    """One for every five frames without a match, one at least where there is one."""
    missing = F.greatest(F.lit(0), frames - matched)
    return F.when(missing == 0, 0).otherwise(F.ceil(missing / 5)).cast("long")


def evidence_quality(coverage: Column, strong: Column, weak: Column, regions: Column) -> Column:
    """blocked, high, medium or low."""
    return (
        F.when((coverage == 0) | (regions >= 6), "blocked")
        .when((coverage >= 0.75) & (strong >= weak) & (regions <= 1), "high")
        .when((coverage >= 0.45) & (regions <= 3), "medium")
        .otherwise("low")
    )


def visual_evidence(anchors: DataFrame, key: str, order: list[str], distance: str = "distance", threshold: float = 0.16, most: int = 160) -> DataFrame:
    """Of each key's anchors every max(1, n div ``most``)-th in order: n_observations, n_supported (distance of
    ``threshold`` at most), mean_distance, support_ratio. Anchors whose distance is null are not observed."""
    w = Window.partitionBy(key)
    seen = anchors.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w)).filter(F.col("_i") % F.greatest(F.lit(1), F.floor(F.col("_n") / most)) == 0).filter(F.col(distance).isNotNull())
    return seen.groupBy(key).agg(F.count("*").alias("n_observations"), F.count_if(F.col(distance) <= threshold).alias("n_supported"), F.avg(distance).alias("mean_distance")).withColumn("support_ratio", F.col("n_supported") / F.col("n_observations"))


def preferred_streams(streams: DataFrame, key: str) -> DataFrame:
    """The audio stream of each key to take: no commentary, the default one, the lowest index."""
    return streams.groupBy(key).agg(F.min(F.struct("is_commentary", (~F.col("is_default")).alias("other"), "stream_index")).alias("s")).select(key, F.col("s.stream_index").alias("stream_index"))


def canonical_landmarks(landmarks: DataFrame, key: str) -> DataFrame:
    """Landmarks with their place in a key: by time, hash, and strength from the top."""
    return landmarks.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("time_ms", "hash", F.desc("strength_milli"), "landmark_id")))


def largest_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The longest stretch that a span of one list has in common with one of the other, 0 at least, for each key of the
    left: a key's spans (start_ms, end_ms) are some dozens."""
    other = right.select(key, F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"))
    met = left.join(other, key, "left")
    return met.groupBy(key).agg(F.greatest(F.lit(0), F.coalesce(F.max(F.least("end_ms", "_e") - F.greatest("start_ms", "_s")), F.lit(0))).alias("overlap_ms"))


#: Pixels a second at either end of the slider, and the slider's length.
ZOOM_MIN, ZOOM_MAX, SLIDER = 0.01, 1600.0, 1000


def zoom_to_slider(zoom: Column) -> Column:
    held = F.least(F.lit(ZOOM_MAX), F.greatest(F.lit(ZOOM_MIN), zoom))
    return F.floor((F.log(held) - F.log(F.lit(ZOOM_MIN))) / (F.log(F.lit(ZOOM_MAX)) - F.log(F.lit(ZOOM_MIN))) * SLIDER + 0.5)


def slider_to_zoom(value: Column) -> Column:
    ratio = F.least(F.lit(SLIDER), F.greatest(F.lit(0), value)) / SLIDER
    return F.exp(F.log(F.lit(ZOOM_MIN)) + (F.log(F.lit(ZOOM_MAX)) - F.log(F.lit(ZOOM_MIN))) * ratio)


def counterpart(at: Column, a: Column, z: Column, ta: Column, tz: Column) -> Column:
    """The place on the other axis of ``at`` in a matched span: linear, rounded half up, one before the end at most. Null
    outside the span and where either side has no length."""
    wide = lambda c: c.cast("decimal(38,0)")
    rounded = F.floor((wide(at - a) * wide(tz - ta) * 2 + wide(z - a)) / (wide(z - a) * 2)).cast("long")
    return F.when((z > a) & (tz > ta) & (at >= a) & (at < z), F.least(tz - 1, ta + rounded))


def boundary_context(at: Column, start: Column, end: Column, radius: int = 3000) -> Column:
    """The interval of ``radius`` on either side of a border, within the map's own; all of that if nothing is left."""
    held = F.least(end, F.greatest(start, at))
    low, high = F.greatest(start, held - radius), F.least(end, held + radius)
    return F.struct(F.when(high > low, low).otherwise(start).alias("start_ms"), F.when(high > low, high).otherwise(end).alias("end_ms"))


def affine_windows(h: DataFrame) -> DataFrame:
    """Decode windows of coarse hypotheses target = scale * source + offset, within both media: the queried part of the
    target with its guard, and the source that it comes from together with the hypothesis' own support and their guard.
    Rows without a window (nothing in common, no positive scale) have nulls."""
    query_start, query_end = F.greatest("query_start_ms", "target_min_ms"), F.least("query_end_ms", "target_max_ms")
    target_start, target_end = F.greatest(query_start - F.col("target_guard_ms"), F.col("target_min_ms")), F.least(query_end + F.col("target_guard_ms"), F.col("target_max_ms"))
    back = lambda t: (t - F.col("offset_ms")) / F.col("scale")
    low = F.least(F.floor(back(target_start) - F.col("source_guard_ms")), F.least("support_start_ms", "support_end_ms") - F.col("source_guard_ms"))
    high = F.greatest(F.ceil(back(target_end) + F.col("source_guard_ms")), F.greatest("support_start_ms", "support_end_ms") + F.col("source_guard_ms"))
    source_start, source_end = F.greatest(low, F.col("source_min_ms")), F.least(high, F.col("source_max_ms"))
    good = (F.col("scale") > 0) & (query_end > query_start)
    whole = F.when(good, F.struct(source_start.alias("s"), source_end.alias("e"), target_start.alias("ts"), target_end.alias("te")))
    found = h.withColumn("_w", whole)
    ok = F.col("_w.e") > F.col("_w.s")
    return found.select(*h.columns, *[F.when(ok, F.col(f"_w.{c}")).alias(n) for c, n in (("s", "source_start_ms"), ("e", "source_end_ms"), ("ts", "target_start_ms"), ("te", "target_end_ms"))])


def spectral_block_score(source: Column, target: Column) -> Column:
    """Likeness of two blocks of frames (arrays of struct(active long, v array<double>), paired by place): 0.6 cosine,
    0.3 cosine of the change since the frame before (the cosine itself after a silent one), 0.1 likeness in activity.
    Frames of less than 100 thousandths of activity on either side do not count; fewer than half make 0, and the
    share of those that count scales the mean."""
    pairs = F.zip_with(source, target, lambda s, t: F.struct(s.alias("s"), t.alias("t"), ((s["active"] >= 100) & (t["active"] >= 100)).alias("on")))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda p, q: p + q)
    minus = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)

    def cosine(a: Column, b: Column, half: bool) -> Column:
        na, nb, d = dot(a, a), dot(b, b), dot(a, b)
        c = d / (F.sqrt(na) * F.sqrt(nb))
        return F.when((na <= 2.220446049250313e-16) | (nb <= 2.220446049250313e-16), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (c + 1) * 0.5 if half else c)))

    def scored(p: Column, before: Column) -> Column:
        plain = cosine(p["s"]["v"], p["t"]["v"], False)
        change = F.when(before["on"], cosine(minus(p["s"]["v"], before["s"]["v"]), minus(p["t"]["v"], before["t"]["v"]), True)).otherwise(plain)
        active = F.greatest(F.lit(0.0), 1 - F.abs(p["s"]["active"] - p["t"]["active"]) / 1000)
        return F.when(p["on"], plain * 0.6 + F.coalesce(change, plain) * 0.3 + active * 0.1)

    scores = F.transform(pairs, lambda p, i: scored(p, F.get(pairs, i - 1)))
    held = F.filter(scores, lambda x: x.isNotNull())
    n, size = F.size(held), F.size(source)
    return F.when(n < F.ceil(size / 2), 0.0).otherwise(F.aggregate(held, F.lit(0.0), lambda p, q: p + q) / F.greatest(n, F.lit(1)) * F.least(F.lit(1.0), n / F.greatest(size, F.lit(1))))


def benchmark_scenarios(gold: DataFrame, long_ms: int = 45 * 60_000) -> DataFrame:
    """``gold`` with the sorted names of what its coordinates prove. Columns: n_source_only, n_target_only, n_ambiguous,
    source_start_ms, source_end_ms, target_start_ms, first and last anchors (first_source_ms, ...; null without), same
    (equal media). Null where nothing is proven."""
    c = F.col
    edits = c("n_source_only") + c("n_target_only") + c("n_ambiguous")
    stretched = (edits == 0) & (c("last_source_ms") > c("first_source_ms")) & (c("last_target_ms") - c("first_target_ms") != c("last_source_ms") - c("first_source_ms"))
    moved = (c("source_start_ms") != c("target_start_ms")) | F.coalesce(c("first_source_ms") != c("first_target_ms"), F.lit(False))
    named = [("ambiguous", c("n_ambiguous") > 0), ("global-offset", moved), ("long-reference", c("source_end_ms") - c("source_start_ms") >= long_ms), ("multi-edit", edits > 1), ("source-only", c("n_source_only") > 0), ("target-only", c("n_target_only") > 0), ("time-stretch", F.coalesce(stretched, F.lit(False)))]
    found = F.array_compact(F.array(*[F.when(on, F.lit(name)) for name, on in named]))
    return gold.withColumn("scenarios", F.when(F.size(found) > 0, F.array_join(found, ",")).when(~c("same"), "codec-variant"))
