"""File names to (season, episode range, part), as columns. Patterns are tried in order; the first that fits names
the result, and the import order stands in where none does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the naming scheme.
_SEP = "[-~_—至到]"
_NUM = r"[一二三四五六七八九十百零〇两\d]+"
_UNIT = "(?:集|话|話)"
SEASON_RANGE = rf"第({_NUM})季第?(\d{{1,3}}){_SEP}(\d{{1,3}}){_UNIT}?"
S_RANGE = rf"(?i)S(\d{{1,2}})E?(\d{{1,3}}){_SEP}E?(\d{{1,3}})"
PLAIN_RANGE = rf"^第?(\d{{1,3}}){_SEP}(\d{{1,3}}){_UNIT}$|^(\d{{1,3}}){_SEP}(\d{{1,3}})$"
DECIMAL_PART = r"^第?(\d{1,3})[._](\d{1,3})(?:\D|$)"
SEASON_SINGLE = rf"第({_NUM})季第?(\d{{1,3}}){_UNIT}?"
S_SINGLE = r"(?i)S(\d{1,2})E(\d{1,3})"
PLAIN_SINGLE = rf"^第?(\d{{1,4}}){_UNIT}?$"
SORT_PREFIX = r"^\s*(\d{1,4})\s*[-_.)、]\s*(.+)$"
_DIGITS = "零〇一二两三四五六七八九"
_VALUES = "001223456789"


def numeral(text: Column) -> Column:
    """Chinese or plain digits below a hundred to a number."""
    plain = F.translate(text, _DIGITS, _VALUES)
    ten = F.instr(text, "十")
    before = F.when(ten == 1, 1).otherwise(F.coalesce(F.translate(F.substr(text, ten - 1, F.lit(1)), _DIGITS, _VALUES).try_cast("int"), F.lit(0)))
    after = F.when(ten == F.length(text), 0).otherwise(F.coalesce(F.translate(F.substr(text, ten + 1, F.lit(1)), _DIGITS, _VALUES).try_cast("int"), F.lit(0)))
    return F.when(text.rlike(r"^\d+$"), text.try_cast("int")).when(ten > 0, before * 10 + after).otherwise(plain.try_cast("int"))


def parse(files: DataFrame, name: str = "file_name", order: str = "source_order") -> DataFrame:
    """``files`` with season, episode_start, episode_end, part, pattern and confidence."""
    stem = F.regexp_replace(F.col(name), r"\.[^.]+$", "")
    prefix = stem.rlike(SORT_PREFIX)
    title = F.regexp_replace(F.when(prefix, F.regexp_extract(stem, SORT_PREFIX, 2)).otherwise(stem), r"\s+", "")
    df = files.withColumn("_t", title)
    t = F.col("_t")
    get = lambda p, g: F.nullif(F.regexp_extract(t, p, g), F.lit(""))
    num = lambda p, g: get(p, g).try_cast("int")
    fits = lambda a, b: F.coalesce((a > 0) & (b > 0) & (F.abs(b - a) + 1).between(2, 80), F.lit(False))
    pa, pb = F.coalesce(num(PLAIN_RANGE, 1), num(PLAIN_RANGE, 3)), F.coalesce(num(PLAIN_RANGE, 2), num(PLAIN_RANGE, 4))
    none = F.lit(None).cast("int")
    row = lambda season, a, b, part, pattern, confidence: F.struct(season.alias("season"), F.least(a, b).alias("episode_start"), F.greatest(a, b).alias("episode_end"), part.alias("part"), F.lit(pattern).alias("pattern"), F.lit(confidence).alias("confidence"))
    first = F.col(order).cast("int") + 1
    found = (
        F.when(fits(num(SEASON_RANGE, 2), num(SEASON_RANGE, 3)), row(numeral(get(SEASON_RANGE, 1)), num(SEASON_RANGE, 2), num(SEASON_RANGE, 3), none, "seasonRange", "high"))
        .when(fits(num(S_RANGE, 2), num(S_RANGE, 3)), row(num(S_RANGE, 1), num(S_RANGE, 2), num(S_RANGE, 3), none, "seRange", "high"))
        .when(fits(pa, pb), row(none, pa, pb, none, "plainRange", "medium"))
        .when(t.rlike(DECIMAL_PART), row(none, num(DECIMAL_PART, 1), num(DECIMAL_PART, 1), num(DECIMAL_PART, 2), "decimalPart", "high"))
        .when(t.rlike(SEASON_SINGLE), row(numeral(get(SEASON_SINGLE, 1)), num(SEASON_SINGLE, 2), num(SEASON_SINGLE, 2), none, "seasonSingle", "high"))
        .when(t.rlike(S_SINGLE), row(num(S_SINGLE, 1), num(S_SINGLE, 2), num(S_SINGLE, 2), none, "seSingle", "high"))
        .when(t.rlike(PLAIN_SINGLE), row(none, num(PLAIN_SINGLE, 1), num(PLAIN_SINGLE, 1), none, "plainSingle", "medium"))
        .otherwise(row(none, first, first, none, "importOrder", "low"))
    )
    return df.withColumn("_r", found).select(*files.columns, "_r.*")
