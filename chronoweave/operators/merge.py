"""Files of episodes merged into a season: ranges split, parts appended, offsets summed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import episodes
from ..functions import exprs as X

#: A quiet gap has this length at least; bins of that width hold no gap inside.
QUIET_MS = 60_000


def mapped_times(items: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """``items`` with mapped_ms: t_ms moved by the sum of all step gaps at or before it."""
    if steps is None:
        return items.withColumn("mapped_ms", F.col("t_ms"))
    knots = steps.agg(F.array_sort(F.collect_list(F.struct("source_at_ms", "target_gap_ms"))).alias("_steps"))
    # One row, joined to every item.
    return items.crossJoin(F.broadcast(knots)).withColumn("mapped_ms", F.col("t_ms") + X.stepped_offset(F.col("t_ms"), F.col("_steps"))).drop("_steps")


def quiet_gaps(items: DataFrame, key: str, t: str, least: int = QUIET_MS) -> DataFrame:
    """Times of a key that follow each other at ``least`` apart or more: key, left_ms, right_ms. Such a gap crosses a
    border of bins of that width, so only each bin's first and last time are compared, not all rows of a key."""
    bins = items.groupBy(key, F.floor(F.col(t) / least).alias("bin")).agg(F.min(t).alias("first"), F.max(t).alias("last"))
    w = Window.partitionBy(key).orderBy("bin")
    return bins.select(key, F.col("last").alias("left_ms"), F.lead("first").over(w).alias("right_ms")).filter(F.col("right_ms") - F.col("left_ms") >= least)


def range_segments(timed: DataFrame, ranges: DataFrame) -> DataFrame:
    """Files that hold several episodes, cut at quiet gaps: asset_id, part (from 1), start_ms, end_ms, at_gap.

    timed: asset_id, mapped_ms. ranges: asset_id, episodes. The expected borders part the time evenly; each goes to
    the middle of the best gap within 0.35 of a part's length (longest gap less a fifth of its distance, the earliest of
    equals), or stays where it is. The last part ends one after the last time. A file without rows has no segments.
    """
    ends = timed.groupBy("asset_id").agg(F.min("mapped_ms").alias("first"), F.max("mapped_ms").alias("last"))
    size = F.greatest(F.lit(1), F.col("last") - F.col("first")) / F.col("episodes")
    held = ends.join(ranges, "asset_id").withColumn("size", size)
    borders = held.select("asset_id", "first", "size", F.explode(F.sequence(F.lit(1), F.col("episodes") - 1)).alias("k")).withColumn("expected", F.col("first") + F.col("size") * F.col("k"))
    middle = (F.col("left_ms") + F.col("right_ms")) / 2
    distance = F.abs(middle - F.col("expected"))
    score = F.col("right_ms") - F.col("left_ms") - distance * 0.2
    # A file has as many borders as episodes less one, some dozens at most, and its gaps are far fewer than its rows.
    best = (
        quiet_gaps(timed.join(ranges.select("asset_id"), "asset_id", "left_semi"), "asset_id", "mapped_ms")
        .join(borders, "asset_id")
        .filter(distance <= F.col("size") * 0.35)
        .groupBy("asset_id", "k")
        .agg(F.max(F.struct(score.alias("score"), (-F.col("left_ms")).alias("l"), middle.alias("m"))).alias("b"))
        .select("asset_id", "k", F.col("b.m").alias("gap_ms"))
    )
    cuts = borders.join(best, ["asset_id", "k"], "left").select("asset_id", "k", F.greatest(F.lit(0), F.floor(F.coalesce("gap_ms", "expected") + 0.5)).alias("at_ms"), F.col("gap_ms").isNotNull().alias("at_gap"))
    edges = cuts.unionByName(held.select("asset_id", F.lit(0).alias("k"), F.col("first").alias("at_ms"), F.lit(True).alias("at_gap"))).unionByName(held.select("asset_id", F.col("episodes").alias("k"), (F.col("last") + 1).alias("at_ms"), F.lit(True).alias("at_gap")))
    # Some rows a file. Dealt out anew, as windows over a union of equally partitioned sides miss rows in Spark 4.1.
    edges = edges.repartition("asset_id")
    w = Window.partitionBy("asset_id").orderBy("k")
    return edges.select("asset_id", (F.col("k") + 1).alias("part"), F.col("at_ms").alias("start_ms"), F.lead("at_ms").over(w).alias("end_ms"), "at_gap").filter("end_ms is not null")


def merge_plan(items: DataFrame, files: DataFrame, steps: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(segments, entries) of a season's files.

    items: asset_id, item_id, t_ms, original_index. files: asset_id, file_name, source_order; a name says season,
    episodes and part (see ``episodes.parse``). A file of several episodes is split (``range_segments``); others are one
    segment from their first row. The segments of an episode follow each other by source order, part and name: each
    begins where the durations of those before end (of a whole file, its last row).

    segments: asset_id, season, episode, part, source_order, start_ms, duration_ms, last_ms, n_items, offset_ms.
    entries: season, episode, item_id, asset_id, t_ms, final_ms.
    """
    parsed = episodes.parse(files).select("asset_id", "file_name", "source_order", "season", "episode_start", "episode_end", F.col("part").alias("own_part"))
    timed = mapped_times(items, steps)
    several = parsed.filter("episode_end > episode_start").select("asset_id", (F.col("episode_end") - F.col("episode_start") + 1).alias("episodes"))
    split = range_segments(timed, several).select("asset_id", "part", "start_ms", "end_ms")
    whole = timed.join(parsed.filter("episode_end = episode_start").select("asset_id"), "asset_id", "left_semi").groupBy("asset_id").agg(F.min_by("mapped_ms", "t_ms").alias("start_ms")).select("asset_id", F.lit(None).cast("int").alias("part"), "start_ms", F.lit(None).cast("long").alias("end_ms"))
    # As many rows as episodes.
    found = split.unionByName(whole).join(parsed, "asset_id")
    segments = found.select("asset_id", "file_name", "source_order", "season", (F.col("episode_start") + F.coalesce(F.col("part") - 1, F.lit(0))).alias("episode"), F.coalesce("part", "own_part").alias("part"), "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"))
    inside = F.col("end_ms").isNull() | (F.col("mapped_ms") >= F.col("start_ms")) & (F.col("mapped_ms") < F.col("end_ms"))
    placed = timed.join(segments, "asset_id").filter(inside).withColumn("local_ms", F.greatest(F.lit(0), F.col("mapped_ms") - F.col("start_ms")))
    filled = placed.groupBy("asset_id", "episode").agg(F.max("local_ms").alias("last_ms"), F.count("*").alias("n_items"))
    w = Window.partitionBy("season", "episode").orderBy("source_order", F.coalesce("part", F.lit(0)), "file_name").rowsBetween(Window.unboundedPreceding, -1)
    length = F.coalesce("duration_ms", "last_ms", F.lit(0))
    segments = segments.join(filled, ["asset_id", "episode"], "left").withColumn("offset_ms", F.coalesce(F.sum(length).over(w), F.lit(0))).withColumn("n_items", F.coalesce("n_items", F.lit(0)))
    entries = placed.join(segments.select("asset_id", "episode", "offset_ms"), ["asset_id", "episode"]).select("season", "episode", "item_id", "asset_id", "t_ms", (F.col("local_ms") + F.col("offset_ms")).alias("final_ms"))
    return segments, entries


def merged_episodes(segments: DataFrame) -> DataFrame:
    """One row per episode in order (season, none first; episode): place, season, episode, file_name, n_files, n_items.
    Seasons are named where there are several."""
    several = segments.agg((F.countDistinct("season") > 1).alias("several"))
    found = segments.groupBy("season", "episode").agg(F.countDistinct("file_name").alias("n_files"), F.sum("n_items").alias("n_items"))
    name = F.when(F.col("several") & F.col("season").isNotNull(), F.format_string("S%02dE%02d.xml", "season", "episode")).otherwise(F.format_string("%d - %d.xml", "episode", "episode"))
    # A season's few episodes.
    return found.crossJoin(F.broadcast(several)).select(F.row_number().over(Window.orderBy(F.coalesce("season", F.lit(0)), "episode")).alias("place"), "season", "episode", name.alias("file_name"), "n_files", "n_items")


def compensation(entries: DataFrame, steps: DataFrame) -> DataFrame:
    """One row: n_markers, total_gap_ms, and the entries and episodes that a step moves (gaps may cancel out)."""
    moved = mapped_times(entries, steps).filter("mapped_ms != t_ms")
    a = steps.agg(F.count("*").alias("n_markers"), F.coalesce(F.sum("target_gap_ms"), F.lit(0)).alias("total_gap_ms"))
    b = moved.agg(F.count("*").alias("n_entries"), F.countDistinct(F.struct(F.coalesce("season", F.lit(-1)), "episode")).alias("n_episodes"))
    return a.crossJoin(F.broadcast(b))


def range_durations(ranges: DataFrame, known: DataFrame) -> DataFrame:
    """Durations of a file's episodes: asset_id, k (from 0), duration_ms, rule. ranges: asset_id, season, episode_start,
    episodes. known: place (from 0), season, episode, duration_ms.

    Each episode's own duration where all are known ("number"); else, in a file without season, the durations at the
    episodes' places in the list, if there are enough ("place"); else the first ones of the list ("first"). Durations
    that are not above 0 are unknown. Fewer than episodes come back where the list is too short.
    """
    wanted = ranges.select("asset_id", "season", "episode_start", "episodes", F.explode(F.sequence(F.lit(0), F.col("episodes") - 1)).alias("k"))
    k = known.select("place", F.col("season").alias("ks"), F.col("episode").alias("ke"), F.col("duration_ms").alias("d"))
    fits = (F.col("ke") == F.col("episode_start") + F.col("k")) & (F.col("ks").isNull() | F.col("season").isNull() | (F.col("ks") == F.col("season")))
    # The first of several that fit counts, even if it is no duration.
    own = wanted.join(k, fits, "left").groupBy("asset_id", "k").agg(F.min_by("d", "place").alias("d")).select("asset_id", "k", F.when(F.col("d") > 0, F.col("d")).alias("duration_ms"), F.lit("number").alias("rule"))
    at = wanted.filter("season is null").join(k, F.col("place") == F.col("episode_start") + F.col("k") - 1).filter("d > 0").select("asset_id", (F.row_number().over(Window.partitionBy("asset_id").orderBy("k")) - 1).alias("k"), F.col("d").alias("duration_ms"), F.lit("place").alias("rule"))
    first = k.filter("d > 0").select((F.row_number().over(Window.orderBy("place")) - 1).alias("k"), F.col("d").alias("duration_ms"))
    listed = wanted.join(first, "k").select("asset_id", "k", "duration_ms", F.lit("first").alias("rule"))
    every = own.unionByName(at).unionByName(listed).filter("duration_ms is not null").join(ranges.select("asset_id", "episodes"), "asset_id")
    enough = every.groupBy("asset_id", "episodes", "rule").agg(F.count("*").alias("n")).filter("n >= episodes or rule = 'first'")
    rank = F.when(F.col("rule") == "number", 0).when(F.col("rule") == "place", 1).otherwise(2)
    chosen = enough.groupBy("asset_id").agg(F.min_by("rule", rank).alias("rule"))
    return every.join(chosen, ["asset_id", "rule"]).select("asset_id", "k", "duration_ms", "rule")


def _parts(edges: DataFrame, rule: str) -> DataFrame:
    """edges: asset_id, a (borders in order). A row for each part."""
    pair = F.transform(F.sequence(F.lit(1), F.size("a") - 1), lambda i: F.struct(i.cast("int").alias("part"), F.get("a", i.cast("int") - 1).alias("start_ms"), F.get("a", i.cast("int")).alias("end_ms")))
    return edges.filter(F.size("a") > 1).select("asset_id", F.inline(pair)).withColumn("rule", F.lit(rule))


def split_ranges(timed: DataFrame, ranges: DataFrame, cuts: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """Files that hold several episodes, cut by hand, by durations or at quiet gaps: asset_id, part (from 1), start_ms, end_ms,
    rule.

    timed: asset_id, mapped_ms. ranges: asset_id, season, episode_start, episodes. With ``cuts`` (asset_id, cut_ms): the first
    ones strictly inside a file's time, one less than its episodes (``cutPoints``). With ``known`` (see ``range_durations``):
    the episodes' durations from the first time on; what lies behind the last one is in no part (``durations``). A file
    with too few of them is cut at quiet gaps (``gaps``, see ``range_segments``). A part holds its start, not its end; the last
    part by durations holds its end, too. A file without rows has no parts.
    """
    ends = timed.groupBy("asset_id").agg(F.min("mapped_ms").alias("first"), F.max("mapped_ms").alias("last")).join(ranges, "asset_id")
    found = None
    if cuts is not None:
        at = F.greatest(F.lit(0), F.floor(F.col("cut_ms") + 0.5)).cast("long")
        inside = cuts.select("asset_id", at.alias("at")).join(ends, "asset_id").filter((F.col("at") > F.col("first")) & (F.col("at") < F.col("last")))
        # The first ones: as many as a file has episodes, some dozens at most.
        w = Window.partitionBy("asset_id").orderBy("at")
        few = inside.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") < F.col("episodes")).groupBy("asset_id", "first", "last", "episodes").agg(F.array_sort(F.collect_list("at")).alias("c"))
        edges = few.filter(F.size("c") == F.col("episodes") - 1).select("asset_id", F.concat(F.array("first"), "c", F.array(F.col("last") + 1)).alias("a"))
        found = _parts(edges, "cutPoints")
    elif known is not None:
        d = range_durations(ranges, known).groupBy("asset_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "duration_ms"))), lambda x: x["duration_ms"]).alias("d"))
        upto = lambda i: F.aggregate(F.slice("d", 1, i.cast("int")), F.col("first").cast("long"), lambda s, x: s + x)
        edges = ends.join(d, "asset_id").filter(F.size("d") >= F.col("episodes")).select("asset_id", F.transform(F.sequence(F.lit(0), F.col("episodes")), upto).alias("a"))
        found = _parts(edges, "durations")
    rest = ranges if found is None else ranges.join(found.select("asset_id").distinct(), "asset_id", "left_anti")
    gaps = range_segments(timed.join(rest.select("asset_id"), "asset_id", "left_semi"), rest.select("asset_id", "episodes")).select("asset_id", F.col("part").cast("int").alias("part"), "start_ms", "end_ms", F.lit("gaps").alias("rule"))
    return gaps if found is None else found.unionByName(gaps)
