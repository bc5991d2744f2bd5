"""Column builders. Times are integer milliseconds (long); intervals are half-open unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column) -> Column:
    """Nearest integer, halves towards plus infinity (-2.5 gives -2)."""
    return F.floor(x + F.lit(0.5))


def clamp_ms(x: Column) -> Column:
    return F.greatest(F.lit(0), round_half_up(x)).cast("long")


def event_ms(ts: Column, origin: str = "2024-01-01") -> Column:
    """Whole milliseconds since ``origin``."""
    return F.unix_millis(ts.cast("timestamp")) - F.unix_millis(F.lit(origin).cast("timestamp"))


def timecode(ms: Column) -> Column:
    """HH:MM:SS.mmm; negatives show as zero."""
    t = F.greatest(F.lit(0).cast("long"), ms.cast("long"))
    whole = lambda unit, wrap: F.floor(t / unit) % wrap if wrap else F.floor(t / unit)
    return F.format_string("%02d:%02d:%02d.%03d", whole(3_600_000, 0), whole(60_000, 60), whole(1_000, 60), t % 1000)


def signed_timecode(ms: Column) -> Column:
    return F.concat(F.when(ms < 0, F.lit("-")).otherwise(F.lit("+")), timecode(F.abs(ms)))


def xml_seconds(ms: Column) -> Column:
    """Seconds with three decimals; negatives become 0."""
    t = F.greatest(F.lit(0).cast("long"), ms.cast("long"))
    return F.format_string("%d.%03d", F.floor(t / 1000), t % 1000)


def decimal_seconds_ms(text: Column) -> Column:
    """Decimal text to milliseconds digit by digit: three decimals, rounded by the fourth. Anything else is null."""
    s = F.trim(text)
    whole = F.regexp_extract(s, r"^(\d+)(?:\.(\d+))?$", 1)
    part = F.rpad(F.regexp_extract(s, r"^(\d+)(?:\.(\d+))?$", 2), 4, "0")
    ms = whole.try_cast("long") * 1000 + F.substring(part, 1, 3).try_cast("long") + (F.substring(part, 4, 1) >= "5").cast("long")
    return F.when(s.rlike(r"^\d+(\.\d+)?$"), ms)


def nullable_long(text: Column) -> Column:
    """Blank or not a finite number: null; else truncated towards zero."""
    d = F.nullif(F.trim(text), F.lit("")).try_cast("double")
    finite = d.isNotNull() & ~F.isnan(d) & (F.abs(d) != F.lit(float("inf")))
    return F.when(finite, d.cast("long"))


def interpolate(t: Column, source_start: Column, source_end: Column, target_start: Column, target_end: Column) -> Column:
    """Image of t under the affine map of a span: nearest integer, halves up, never the exclusive end.

    Decimal arithmetic, so that no product of two durations overflows.
    """
    wide = "decimal(20,0)"
    num = (2 * (t - source_start)).cast(wide) * (target_end - target_start).cast(wide) + (source_end - source_start).cast(wide)
    den = (2 * (source_end - source_start)).cast(wide)
    return F.least(target_end - 1, target_start + F.floor(num / den).cast("long"))


def stepped_offset(t: Column, steps: Column) -> Column:
    """Sum of the gaps of all steps (array of struct<source_at_ms, target_gap_ms>) at or before t."""
    return F.aggregate(F.filter(steps, lambda s: s["source_at_ms"] <= t), F.lit(0).cast("long"), lambda acc, s: acc + s["target_gap_ms"])


def rms_distance(a: Column, b: Column) -> Column:
    """Root mean square of differences; a missing dimension counts as 0; 1 if both are empty."""
    n = F.greatest(F.size(a), F.size(b))
    square = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double"), F.lit(0.0)) - F.coalesce(y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda acc, d: acc + d * d)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.sqrt(square / n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, d: acc + d)


def cosine_cost(a: Column, b: Column) -> Column:
    """(1 - cosine) in thousandths, 0 to 2000; 1000 where a vector is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    cost = F.least(F.lit(2.0), F.greatest(F.lit(0.0), 1 - dot(a, b) / norms)) * 1000
    return F.when(norms <= 1e-12, F.lit(1000)).otherwise(round_half_up(cost)).cast("long")


def quantised_key(v: Column, dims: int = 4, steps: int = 32) -> Column:
    """First ``dims`` values in whole steps, as text."""
    return F.array_join(F.transform(F.slice(v, 1, dims), lambda x: round_half_up(x.cast("double") * steps).cast("string")), ":")


def bucket_size_ms(pixels_per_second: Column) -> Column:
    """Bucket for a zoom level."""
    p = pixels_per_second
    return F.when(p < 18, 30_000).when(p < 45, 10_000).when(p < 130, 1_000).when(p < 420, 500).otherwise(100)


def ladder(x: Column, steps: list[tuple[float, float]], otherwise: float) -> Column:
    """First value whose bound is at or above x."""
    out = None
    for bound, value in steps:
        out = F.when(x <= bound, value) if out is None else out.when(x <= bound, value)
    return out.otherwise(otherwise)
