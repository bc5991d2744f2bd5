"""Names, search texts and what is to be hidden in them, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exprs import timecode  # noqa: F401


def normalised(text: Column) -> Column:
    """Lower case, without a file ending, season and episode as s1 and e2, everything else but letters a-z, digits
    and CJK as single spaces."""
    t = F.lower(text)
    for pattern, into in ((r"\.[a-z0-9]+$", ""), (r"第\s*([0-9]+)\s*季", "s$1"), (r"第\s*([0-9]+)\s*[集话]", "e$1"), (r"[^a-z0-9一-鿿]+", " ")):
        t = F.regexp_replace(t, pattern, into)
    return F.trim(t)


def title_score(tokens: Column, text: Column, episode: Column) -> Column:
    """How well a text names its target: share of its tokens found in the text, and whether its episode number is there."""
    t = normalised(text)
    hits, n = F.size(F.filter(tokens, lambda x: F.contains(t, x))), F.size(tokens)
    number = F.concat(F.lit("(^|[^0-9])("), episode.cast("string"), F.lit("|"), F.lpad(episode.cast("string"), 2, "0"), F.lit(")([^0-9]|$)"))
    found = F.coalesce(F.regexp_like(text, number), F.lit(False))
    score = 0.55 + F.when(n == 0, 0.0).otherwise(hits / n) * 0.35 + F.when(found, 0.15).otherwise(0.0)
    return F.when((hits == 0) & ~found, F.when(n == 0, 0.5).otherwise(0.35)).otherwise(F.least(F.lit(1.0), score))


def duration_score(difference: Column, ratio: Column) -> Column:
    d = F.abs(difference)
    return F.when((d <= 60_000) | (ratio <= 0.02), 1.0).when((d <= 300_000) | (ratio <= 0.1), 0.72).when((d <= 900_000) | (ratio <= 0.25), 0.42).otherwise(0.12)


def density_score(items: Column, minutes: Column) -> Column:
    return F.when((items >= 200) & (minutes >= 20), 1.0).when((items >= 50) & (minutes >= 8), 0.72).when((items >= 10) & (minutes >= 3), 0.5).otherwise(0.3)


def state(score: Column) -> Column:
    return F.when(score >= 0.75, "positive").when(score >= 0.5, "neutral").when(score >= 0.25, "warning").otherwise("negative")


def search_terms(text: Column) -> Column:
    """struct<keyword, season, episode> of a search: S1E2, 第1季第2集, 1x2, or an episode alone."""
    raw = F.trim(text)
    both = [r"(?i)S(\d{1,2})\s*E(\d{1,3})", r"第\s*(\d{1,2})\s*季\s*第?\s*(\d{1,3})\s*(?:集|话|話)?", r"(\d{1,2})\s*[xX]\s*(\d{1,3})"]
    alone = r"(?i)(?:E|第)\s*(\d{1,3})\s*(?:集|话|話)?"
    tidy = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"[,:：，;；_-]+$", ""), r"\s+", " "))
    number = lambda p, g: F.nullif(F.regexp_extract(raw, p, g), F.lit("")).try_cast("int")
    row = lambda p, season, episode: F.struct(tidy(_replace_first(raw, p)).alias("keyword"), season.alias("season"), episode.alias("episode"))
    none = F.lit(None).cast("int")
    out = F.when(raw.rlike(both[0]), row(both[0], number(both[0], 1), number(both[0], 2)))
    for p in both[1:]:
        out = out.when(raw.rlike(p), row(p, number(p, 1), number(p, 2)))
    return out.when(raw.rlike(alone), row(alone, none, number(alone, 1))).otherwise(F.struct(tidy(raw).alias("keyword"), none.alias("season"), none.alias("episode")))


def _replace_first(text: Column, pattern: str) -> Column:
    hit = F.regexp_substr(text, F.lit(pattern))
    at = F.locate("\u0000", F.replace(text, hit, F.lit("\u0000")))
    return F.concat(F.substr(text, F.lit(1), at - 1), F.lit(" "), F.substr(text, at + F.length(hit), F.length(text)))


def search_score(keyword: Column, season: Column, episode: Column, name: Column, item_season: Column, item_episode: Column, kind: Column, duration: Column) -> Column:
    """Points of a candidate: name 80, 40 or 20, season +30 or -10, episode +45 or -10, type +10, known duration +2."""
    k, n = F.lower(F.trim(keyword)), F.lower(F.trim(name))
    named = F.when((F.length(k) == 0) | (F.length(n) == 0), 0).when(n == k, 80).when(F.contains(n, k), 40).when(F.contains(k, n), 20).otherwise(0)
    part = lambda want, got, plus: F.when(want.isNull() | got.isNull(), 0).when(want == got, plus).otherwise(-10)
    return named + part(season, item_season, 30) + part(episode, item_episode, 45) + F.when(episode.isNotNull() & (kind == "Episode"), 10).otherwise(0) + F.when(duration.isNotNull(), 2).otherwise(0)


def redacted(text: Column, secrets: list[str], into: str = "[hidden]") -> Column:
    """Known secrets (either slash, any case, longest first) and 64-digit hashes hidden."""
    forms = {v.lower(): v for s in secrets if s for v in (s, s.replace("\\", "/"), s.replace("/", "\\"), s.replace("\\", "\\\\"))}
    for v in sorted(forms.values(), key=lambda v: (-len(v), v)):
        text = F.regexp_replace(text, "(?iu)" + re.escape(v), into)
    return F.regexp_replace(text, r"(?i)\b[a-f0-9]{64}\b", "[hidden sha-256]")


def safe_file_name(text: Column) -> Column:
    """Without characters that file systems refuse, spaces tidied, never empty."""
    t = F.trim(F.regexp_replace(F.regexp_replace(text, r'[\\/:*?"<>|\x00-\x1f]+', "_"), r"\s+", " "))
    return F.when(F.length(t) == 0, "untitled").otherwise(t)


def unique_names(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """A number after each further use of one name (case ignored): a, a (2), a (3)."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(F.lower(name)).orderBy(*order))
    return df.withColumn("unique_name", F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" ("), n, F.lit(")"))))


def string_hash(text: Column) -> Column:
    """h = h * 31 + code, modulo 2^32, over the characters; the code of one beyond U+FFFF is its first UTF-16 unit."""
    code = lambda c: F.when(F.ascii(c) > 0xFFFF, 0xD800 + F.shiftright(F.ascii(c) - 0x10000, 10)).otherwise(F.ascii(c))
    return F.aggregate(F.filter(F.split(text, ""), lambda c: F.length(c) > 0), F.lit(0).cast("long"), lambda h, c: (h * 31 + code(c)) % F.lit(2**32))
