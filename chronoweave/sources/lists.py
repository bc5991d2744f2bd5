"""Small hand-written lists: cut points, anchor pairs, episode durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _numbers(parts: Column) -> Column:
    """Parts as numbers: an empty one is 0, one that is no number or below 0 is null."""
    number = lambda x: F.when(F.trim(x) == "", F.lit(0.0)).when(x.rlike(_NUMBER), F.trim(x).try_cast("double"))
    return F.transform(parts, lambda x: F.when(number(x) >= 0, number(x)))


def _clock_ms(text: Column) -> Column:
    """h:m:s or m:s to milliseconds: seconds below 60, minutes below 60 after hours."""
    n = _numbers(F.split(text, ":"))
    of = lambda i: F.try_element_at(n, F.lit(i))
    three = F.size(n) == 3
    h, m = F.when(three, of(-3)).otherwise(F.lit(0.0)), of(-2)
    fits = F.size(n).between(2, 3) & (of(-1) < 60) & (~three | (m < 60))
    return F.when(fits, F.floor((h * 3600 + m * 60 + of(-1)) * 1000 + 0.5))


def manual_ms(text: Column) -> Column:
    """As people write cuts and lengths: h:m:s or m:s, or minutes with or without a unit; white space counts for nothing."""
    t = F.regexp_replace(text, r"[\s\u00a0\u3000]+", "")
    minutes = F.regexp_extract(t, r"(?i)^([0-9]+(?:\.[0-9]+)?)(?:分钟|分|min|m)?$", 1)
    return F.when(t.contains(":"), _clock_ms(t)).when(minutes != "", F.floor(minutes.try_cast("double") * 60 * 1000 + 0.5))


def anchor_ms(text: Column) -> Column:
    """As anchors are written: h:m:s or m:s."""
    return _clock_ms(F.trim(text))


def timecode_ms(text: Column) -> Column:
    """As a source's places are written: h:m:s, m:s or seconds, with up to three decimals, all but hours below 60."""
    t = F.trim(text)
    p = F.split(t, ":")
    part = lambda i: F.coalesce(F.try_element_at(p, F.lit(i)).try_cast("long"), F.lit(0))
    last = F.split(F.element_at(p, -1), r"\.")
    seconds = F.element_at(last, 1).try_cast("long")
    thousandths = F.rpad(F.coalesce(F.try_element_at(last, F.lit(2)), F.lit("")), 3, "0").try_cast("long")
    minutes, hours = F.when(F.size(p) >= 2, part(-2)).otherwise(0), F.when(F.size(p) == 3, part(-3)).otherwise(0)
    return F.when(t.rlike(r"^(\d+:){0,2}\d+(\.\d{1,3})?$") & (minutes < 60) & (seconds < 60), ((hours * 60 + minutes) * 60 + seconds) * 1000 + thousandths)


def _lines(rows: DataFrame, text: str, comment: str | None = None) -> DataFrame:
    """A row for each line that is not empty (nor begins with ``comment``): ``line``, its number among those from 1, and _l."""
    trimmed = F.transform(F.split(F.col(text), r"\r?\n"), lambda x: F.regexp_replace(x, r"^[\s\u00a0\u3000]+|[\s\u00a0\u3000]+$", ""))
    kept = F.filter(trimmed, lambda x: (x != "") & (~x.startswith(comment) if comment else F.lit(True)))
    return rows.select(*[c for c in rows.columns if c != text], F.posexplode(kept).alias("line", "_l")).withColumn("line", F.col("line") + 1)


def cut_points(rows: DataFrame, text: str = "text") -> DataFrame:
    """Rows with cut_ms, the times in a list separated by line breaks, commas or semicolons, ascending, and not_understood,
    what is no time. A null text gives nulls."""
    tokens = F.filter(F.transform(F.split(F.col(text), r"[\n,，;；]+"), lambda x: F.trim(F.regexp_replace(x, r"\r", ""))), lambda x: x != "")
    return rows.withColumn("cut_ms", F.array_sort(F.array_compact(F.transform(tokens, manual_ms)))).withColumn("not_understood", F.filter(tokens, lambda x: manual_ms(x).isNull()))


def anchor_lines(rows: DataFrame, text: str = "text") -> DataFrame:
    """Lines 'a -> b' (arrows, commas or tabs between the times): line, source_ms, target_ms, warning. Lines that begin with #
    are left out and not counted. warning: ``notAPair`` or ``badTime``, null for an anchor."""
    p = F.filter(F.split("_l", r"\s*(?:->|=>|→|,|，|\t)\s*"), lambda x: x != "")
    a, b = (anchor_ms(F.try_element_at(p, F.lit(i))) for i in (1, 2))
    warning = F.when(F.size(p) != 2, "notAPair").when(a.isNull() | b.isNull(), "badTime")
    found = _lines(rows, text, "#").withColumn("warning", warning)
    return found.withColumn("source_ms", F.when(F.col("warning").isNull(), a)).withColumn("target_ms", F.when(F.col("warning").isNull(), b)).drop("_l")


def anchors(rows: DataFrame, text: str = "text") -> DataFrame:
    """The anchors among ``anchor_lines``; their order is by source_ms, target_ms and line."""
    return anchor_lines(rows, text).filter("warning is null").drop("warning")


def duration_lines(rows: DataFrame, text: str = "text") -> DataFrame:
    """Lines that end in a length (h:m:s, m:s, or minutes with or without a unit) after a label: line, season, episode,
    duration_ms. The label is S1E2, 第1季第2集, or one that ends in an episode's number (season null); without one the line's
    number is the episode. duration_ms is null, and so are the others, for a line without a length above 0."""
    rx = r"(?i)([0-9]+(?::[0-9]{1,2}){1,2}(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?\s*(?:分钟|分|min|m)?)\s*$"
    length = manual_ms(F.regexp_extract("_l", rx, 1))
    label = F.trim(F.regexp_replace(F.regexp_replace("_l", rx, ""), r"[=:：,-]+$", ""))
    found = _lines(rows, text).withColumn("duration_ms", F.when(length > 0, length)).withColumn("_label", label)
    g = lambda pattern, i: F.nullif(F.regexp_extract("_label", pattern, i), F.lit("")).cast("int")
    both, chinese, plain = r"(?i)S(\d{1,2})E(\d{1,3})", "第?(\\d{1,2})季第?(\\d{1,3})(?:集|话|話)?", "(?i)(?:E|第)?(\\d{1,3})(?:集|话|話)?$"
    season, episode = F.coalesce(g(both, 1), g(chinese, 1)), F.coalesce(g(both, 2), g(chinese, 2), g(plain, 1), F.col("line"))
    known = F.col("duration_ms").isNotNull()
    return found.withColumn("season", F.when(known, season)).withColumn("episode", F.when(known, episode)).drop("_l", "_label")


def durations(rows: DataFrame, text: str = "text") -> DataFrame:
    """The lengths among ``duration_lines``."""
    return duration_lines(rows, text).filter("duration_ms is not null")


def presentation_gaps(records: DataFrame, line: str = "value", key: str = "stream_index", pts: str = "pts_time", jump_ms: int = 1_000) -> DataFrame:
    """Compact 'k=v|k=v' records to per-stream first and last time, frames, longest gap and jumps."""
    kv = records.select(F.str_to_map(F.col(line), F.lit("\\|"), F.lit("=")).alias("m"))
    rows = kv.select(F.col("m")[key].try_cast("int").alias("stream"), F.floor(F.col("m")[pts].try_cast("double") * 1000 + 0.5).alias("ms")).filter("stream is not null and ms is not null")
    from pyspark.sql import Window

    gap = F.col("ms") - F.lag("ms").over(Window.partitionBy("stream").orderBy("ms"))
    return rows.withColumn("gap", gap).groupBy("stream").agg(F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"), F.count("*").alias("n_frames"), F.max("gap").alias("longest_gap_ms"), F.count_if(F.col("gap") > jump_ms).alias("n_jumps"))
