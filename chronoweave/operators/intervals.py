"""Interval algebra on DataFrames. Pure range conditions would plan as nested loops, so every join here has an
equality on a time bin as well; an interval stands in each bin that it touches, a point in one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Each level's bins are so many times as wide as those of the level below; an interval touches one more at most.
STEP = 16


def bins(start: Column, end: Column, width: int | Column) -> Column:
    """Bins that [start, end) touches; an empty interval touches that of its start."""
    return F.sequence(F.floor(start / width), F.floor(F.greatest(start, end - 1) / width))


def level(start: Column, end: Column, width: int) -> Column:
    """Lowest level at which an interval is at most STEP bins long."""
    return F.greatest(F.lit(0), F.ceil(F.log((end - start) / F.lit(width * STEP)) / F.log(F.lit(STEP)) - 1e-9)).cast("int")


def _levels(spans: DataFrame, start: str, end: str, width: int) -> list[int]:
    """The levels that intervals are at: a handful of numbers, since each is STEP times as long as the last."""
    found = spans.filter(F.col(end) > F.col(start)).select(level(F.col(start), F.col(end), width).alias("v")).distinct()
    return sorted(r["v"] for r in found.collect())


def _wide(width: int, lv: Column | int) -> Column:
    return (F.lit(width) * F.pow(F.lit(STEP), lv if isinstance(lv, Column) else F.lit(lv))).cast("long")


def range_join(points: DataFrame, spans: DataFrame, t: str, start: str, end: str, on: list[str] | None = None, width: int = 3_600_000, how: str = "inner") -> DataFrame:
    """Points with each half-open span that holds them. Columns ``on`` must be equal too and appear once.

    Spark chooses broadcast or shuffle by size. Long spans take wider bins, so none is in many; a point has one
    bin for each width in use (one, if spans are alike). A key that holds a large share of the points is cut by
    its bins. ``how``: inner or left_semi.
    """
    on = on or []
    levels = _levels(spans, start, end, width)
    if not levels:
        levels = [0]
    p = points.withColumn("_level", F.explode(F.array(*[F.lit(v) for v in levels])) if len(levels) > 1 else F.lit(levels[0])).withColumn("_bin", F.floor(F.col(t) / _wide(width, F.col("_level"))))
    s = spans.filter(F.col(end) > F.col(start)).withColumn("_level", level(F.col(start), F.col(end), width)).withColumn("_bin", F.explode(bins(F.col(start), F.col(end), _wide(width, F.col("_level")))))
    cond = [F.col(f"p.{c}") == F.col(f"s.{c}") for c in [*on, "_level", "_bin"]] + [F.col(f"p.{t}") >= F.col(f"s.{start}"), F.col(f"p.{t}") < F.col(f"s.{end}")]
    joined = p.alias("p").join(s.alias("s"), cond, how)
    if how == "left_semi":
        return joined.drop("_level", "_bin").distinct() if len(levels) > 1 else joined.drop("_level", "_bin")
    return joined.select(*[F.col(f"p.{c}") for c in points.columns], *[F.col(f"s.{c}") for c in spans.columns if c not in on])


def overlap_pairs(spans: DataFrame, key: list[str], row_id: str, start: str, end: str, width: int, residual: Column | None = None) -> DataFrame:
    """Pairs (left, right, overlap) of intervals of one key that overlap, each once, left before right by
    (start, id). Two intervals meet at the higher of their levels, in the bin where their overlap begins."""
    levels = _levels(spans, start, end, width)
    own = spans.filter(F.col(end) > F.col(start)).withColumn("_own", level(F.col(start), F.col(end), width))
    at = F.explode(F.filter(F.array(*[F.lit(v) for v in levels or [0]]), lambda v: v >= F.col("_own")))
    s = own.withColumn("_level", at).withColumn("_bin", F.explode(bins(F.col(start), F.col(end), _wide(width, F.col("_level")))))
    a, b = s.alias("a"), s.alias("b")
    begin = F.greatest(F.col(f"a.{start}"), F.col(f"b.{start}"))
    before = (F.col(f"a.{start}") < F.col(f"b.{start}")) | ((F.col(f"a.{start}") == F.col(f"b.{start}")) & (F.col(f"a.{row_id}") < F.col(f"b.{row_id}")))
    once = (F.greatest(F.col("a._own"), F.col("b._own")) == F.col("a._level")) & (F.floor(begin / _wide(width, F.col("a._level"))) == F.col("a._bin"))
    cond = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*key, "_level", "_bin"]] + [before, F.col(f"b.{start}") < F.col(f"a.{end}"), once]
    if residual is not None:
        cond.append(residual)
    overlap = F.least(F.col(f"a.{end}"), F.col(f"b.{end}")) - begin
    return a.join(b, cond).select(*[F.col(f"a.{c}") for c in key], F.col(f"a.{row_id}").alias("left_id"), F.col(f"b.{row_id}").alias("right_id"), overlap.alias("overlap"))


def merged(spans: DataFrame, key: list[str], start: str, end: str, touch: int = 0) -> DataFrame:
    """Union of a key's intervals as disjoint ones (gaps of up to ``touch`` close), with how many each joins."""
    w = Window.partitionBy(*key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col(start) > reach + touch), 1).otherwise(0)
    marked = spans.filter(F.col(end) > F.col(start)).withColumn("_open", opens)
    return marked.withColumn("_island", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_spans")).drop("_island")


def union_length(spans: DataFrame, key: list[str], start: str, end: str, width: int) -> DataFrame:
    """Length of the union of a key's intervals. Lengths add over bins, so a key is cut by bins before its rows
    meet: no task sorts a whole key."""
    cut = (
        spans.filter(F.col(end) > F.col(start))
        .withColumn("_bin", F.explode(bins(F.col(start), F.col(end), width)))
        .select(*key, "_bin", F.greatest(F.col(start), F.col("_bin") * width).alias("_a"), F.least(F.col(end), (F.col("_bin") + 1) * width).alias("_z"))
        .distinct()
    )
    w = Window.partitionBy(*key, "_bin").orderBy("_a", "_z").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("_z").over(w), F.col("_a"))
    return cut.select(*key, F.greatest(F.lit(0), F.col("_z") - F.greatest("_a", reach)).alias("_new")).groupBy(*key).agg(F.sum("_new").alias("covered"))


def runs(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Maximal runs of equal values in order: key, run, first and last row number, value, n_rows."""
    w = Window.partitionBy(*key).orderBy(*order)
    numbered = df.withColumn("_rn", F.row_number().over(w)).withColumn("_new", F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.col("_rn") > 1), 0).otherwise(1))
    return numbered.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def nearest(points: DataFrame, frames: DataFrame, t: str, frame_t: str, within: int, point_id: str, frame_id: str, on: list[str] | None = None, later_wins: bool = False) -> DataFrame:
    """For each point the nearest frame at most ``within`` away, or none; of equals the earlier (or later) one."""
    on = on or []
    width = max(1, within)
    sign = -1 if later_wins else 1
    # Points and frames meet in one shuffle by bins, and nothing is joined back to the points.
    side = lambda df, at, point, frame: df.filter(" and ".join(f"`{c}` is not null" for c in [*on, at])).select(*on, F.col(at).alias("_t"), point.alias("_point"), frame.alias("_frame"), F.lit(df is frames).alias("_is"))
    asked = side(points, t, F.col(point_id), F.lit(None))
    given = side(frames, frame_t, F.lit(None), F.col(frame_id) * sign)
    in_bin = F.floor(F.col("_t") / width).alias("_bin")
    # Parts of a fixed number: joined by size, they would sort on disk.
    parts = max(1, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    every = asked.unionByName(given).select("*", in_bin).repartition(parts, *on, "_bin")
    # A frame that near is in the same bin or in one beside it: the last of the bin before, or the first of the one after.
    first, last = F.min(F.struct("_t", F.col("_frame").isNull().alias("n"), "_frame")), F.max(F.struct("_t", (-F.col("_frame")).alias("m")))
    ends = given.select("*", in_bin).groupBy(*on, "_bin").agg(first.alias("f"), last.alias("l"))
    beside = lambda k, at, frame, name: ends.select(*on, (F.col("_bin") + k).alias("_bin"), F.struct(at.alias("_t"), frame.alias("_frame")).alias(name))
    before, after = beside(1, F.col("l._t"), -F.col("l.m"), "_last_beside"), beside(-1, F.col("f._t"), F.col("f._frame"), "_first_beside")
    # Both ways a growing frame: one that shrinks would be read anew for each row. Of one time, frames come before points, and
    # the frame to be taken last.
    here = F.when(F.col("_is"), F.struct("_t", "_frame"))
    order = lambda time: Window.partitionBy(*on, "_bin").orderBy(time, F.desc("_is"), F.desc_nulls_first("_frame")).rowsBetween(Window.unboundedPreceding, 0)
    near = {name: F.last(here, True).over(order(time)) for name, time in (("_before", F.asc("_t")), ("_after", F.desc("_t")))}
    seen = every.withColumns(near).filter("not _is").join(before, [*on, "_bin"], "left").join(after, [*on, "_bin"], "left")
    rank = lambda c: F.when(c.isNotNull(), F.struct(F.abs(F.col("_t") - c["_t"]).alias("d"), (c["_t"] * sign).alias("t"), c["_frame"].alias("i")))
    best = seen.select("_point", F.least(rank(F.coalesce("_before", "_last_beside")), rank(F.coalesce("_after", "_first_beside"))).alias("r")).filter(F.col("r.d") <= within)
    return best.groupBy("_point").agg(F.min("r").alias("r")).select(F.col("_point").alias(point_id), (F.col("r.i") * sign).alias("frame_id"), F.col("r.d").alias("distance"))


def near_exists(left: DataFrame, right: DataFrame, lt: str, rt: str, within: int, on: list[str] | None = None, how: str = "left_semi") -> DataFrame:
    """Left rows with (or without: left_anti) a right row at most ``within`` away. The right side is the one that
    stands in three bins, so left rows keep their number."""
    on = on or []
    width = max(1, within)
    r = right.select(*on, rt, F.explode(F.array(*[F.floor(F.col(rt) / width) + k for k in (-1, 0, 1)])).alias("_bin"))
    lb = left.withColumn("_bin", F.floor(F.col(lt) / width))
    cond = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in [*on, "_bin"]] + [F.abs(F.col(f"l.{lt}") - F.col(f"r.{rt}")) <= within]
    return lb.alias("l").join(r.alias("r"), cond, how).drop("_bin")
