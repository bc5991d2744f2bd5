"""Small literal relations, the same for Spark and SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

DAY = 86_400_000
_SQL = {"string": "VARCHAR", "long": "BIGINT", "boolean": "BOOLEAN", "int": "INTEGER", "double": "DOUBLE"}


@dataclass(frozen=True)
class Literal:
    name: str
    schema: str  # "a string, b long"
    rows: tuple[tuple, ...]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.schema)

    def cte(self) -> str:
        fields = [f.strip().split(" ") for f in self.schema.split(",")]

        def value(x: object) -> str:
            if x is None:
                return "NULL"
            if isinstance(x, bool):
                return str(x).upper()
            return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)

        body = ", ".join("(" + ", ".join(map(value, r)) + ")" for r in self.rows)
        cast = ", ".join(f"CAST(c{i} AS {_SQL[t]}) AS {n}" for i, (n, t) in enumerate(fields))
        names = ", ".join(f"c{i}" for i in range(len(fields)))
        return f"{self.name} AS (SELECT {cast} FROM (VALUES {body}) AS v({names}))"


KINDS = ("click", "view", "purchase", "signup", "error")
CLIPS = Literal(
    "clips",
    "clip_id string, asset_id string, timeline_start_ms long, source_in_ms long, source_out_ms long, local_offset_ms long, enabled boolean",
    tuple((f"c{i}", KINDS[i % 5], i * 7 * DAY // 2, (i // 5) * 6 * DAY, (i // 5) * 6 * DAY + 8 * DAY, (i - 4) * 250, i != 7) for i in range(15)),
)
STEPS = Literal("steps", "source_at_ms long, target_gap_ms long", ((3 * DAY, 45_000), (3 * DAY + 30_000, 15_000), (11 * DAY, -5_000), (40 * DAY, 90_000)))
ADJUST_EVERY = 97
SPANS = Literal(
    "spans",
    "map_id string, span_index long, kind string, source_start_ms long, source_end_ms long, target_start_ms long, target_end_ms long",
    tuple(
        (m, i, kind, a * DAY + shift, b * DAY + shift, c * DAY, d * DAY)
        for m, shift in (("click", 0), ("view", DAY), ("purchase", 2 * DAY), ("error", 0))
        for i, (kind, a, b, c, d) in enumerate((("matched", 0, 5, 1, 6), ("sourceOnly", 5, 7, 6, 6), ("targetOnly", 7, 7, 6, 8), ("matched", 7, 12, 8, 11), ("ambiguous", 12, 12, 11, 12), ("ambiguous", 12, 15, 12, 14), ("matched", 15, 22, 14, 23)))
    ),
)
BAD_SPANS = Literal(
    "bad_spans",
    SPANS.schema,
    (
        ("a", 0, "matched", 0, 100, 0, 100), ("a", 1, "sourceOnly", 100, 150, 100, 100), ("a", 2, "targetOnly", 150, 150, 100, 180), ("a", 3, "matched", 150, 300, 180, 300),
        ("b", 0, "matched", 0, 0, 0, 50), ("b", 1, "sourceOnly", 10, 40, 50, 60), ("b", 2, "matched", 30, 20, 60, 80), ("b", 3, "ambiguous", 20, 20, 80, 80), ("b", 4, "targetOnly", 25, 30, 70, 90),
    ),
)
RANGES = Literal("ranges", "map_id string, source_start_ms long, source_end_ms long, target_start_ms long", (("a", 0, 1000, 500), ("b", 100, 900, 0), ("c", 0, 400, 0), ("d", 0, 600, 50)))
RULES = Literal("rules", "map_id string, source_at_ms long, gap_ms long", (("a", 200, 50), ("a", 200, 25), ("a", 600, 100), ("b", 100, 30), ("b", 400, 0), ("b", 950, 10), ("c", 100, 20), ("c", 200, -40), ("c", 300, 60)))
SEGMENTS = Literal(
    "segments",
    "segment_id string, kind string, asset_id string, source_id string, source_start_ms long, source_end_ms long, target_id string, map_id string",
    (
        ("s1", "content", "click", "m_click", 0, 10 * DAY, "t1", "click"), ("s2", "content", "click", "m_click", 10 * DAY, 22 * DAY, "t2", "click"), ("s3", "content", "view", "m_view", DAY, 14 * DAY, "t1", "view"),
        ("s4", "ignored", "view", "m_view", 15 * DAY, 18 * DAY, None, None), ("s5", "content", "purchase", "m_purchase", 0, 30 * DAY, "t3", "purchase"), ("s6", "content", "error", "m_other", 0, 5 * DAY, "t2", "error"),
        ("s7", "content", "signup", "m_signup", 0, 8 * DAY, "t1", None), ("s8", "content", "error", "m_error", 2 * DAY, 9 * DAY, "t2", "error"), ("s9", "ignored", "error", "m_error", 8 * DAY, 12 * DAY, None, None),
    ),
)
BINDINGS = Literal("bindings", "asset_id string, source_id string", tuple((k, f"m_{k}") for k in KINDS))
MEDIA = Literal("media", "media_id string, role string, duration_ms long", (*((f"m_{k}", "reference", 30 * DAY) for k in KINDS), ("t1", "target", 25 * DAY), ("t2", "target", 12 * DAY), ("t3", "target", None)))
MAPS = Literal("maps", "map_id string, state string, source_id string, target_id string", (("click", "confirmed", "m_click", "t1"), ("view", "confirmed", "m_view", "t1"), ("purchase", "confirmed", "m_purchase", "t3"), ("error", "candidate", "m_error", "t2")))
FILES = Literal("files", "file_name string, source_order long", tuple((n, i) for i, n in enumerate(("第二季第1-12集.xml", "S02E03-E05.xml", "01-10.xml", "第3.2集.xml", "第十一季第7话.xml", "Show S01E09 final.xml", "第12集.xml", "random name.xml", "003、第一季08.xml", "5_1.xml", "07 - S1E2.xml", "1-90.xml", "第二十季第3集.xml"))))
NUMBERS = Literal("numbers", "x double", ((-2.5,), (-0.5,), (0.5,), (2.5,), (1234.4999,), (99.0,)))
SEARCHES = Literal("searches", "q string", tuple((q,) for q in ("Show S1E02", "剧名 第2季第03集", "Show 1x12 -", "第 7 话 剧", "plain words,", "E5", "")))
PROJECTS = Literal(
    "projects",
    "value string",
    (
        ('{"schemaVersion":1,"id":"old","clips":[{"id":"c1","assetId":"a","timelineStartMs":0,"sourceInMs":0,"sourceOutMs":999,"enabled":true}]}',),
        ('{"schemaVersion":13,"id":"new","clips":[{"id":"c2","assetId":"a","timelineStartMs":5,"sourceInMs":10,"sourceOutMs":20,"localOffsetMs":-3}],"mediaTimeMaps":[{"id":"m","state":"confirmed","sourceMediaId":"s","targetMediaId":"t","spans":[{"kind":"matched","sourceStartMs":0,"sourceEndMs":5,"targetStartMs":1,"targetEndMs":6},{"kind":"sourceOnly","sourceStartMs":5,"sourceEndMs":9,"targetStartMs":6,"targetEndMs":6}]}]}',),
        ('{"schemaVersion":99,"id":"future","clips":[{"id":"c3"}]}',),
        ("no json",),
    ),
)
