"""Queries and SQL for the evidence of time maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence, sequence
from . import fixtures as L
from .oracle import _ITEMS, ORACLE
from .queries import items, query, table

DAY = L.DAY
FRAME_MS, INSERTED, AT = 500, 6, 20
#: Frames of each label's recording, and the same one with six other frames inserted after the twentieth.
_RECORDINGS = f"""frames AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    whole AS (SELECT label, CASE WHEN i < {AT} THEN i ELSE i + {INSERTED} END AS i, v FROM frames
              UNION ALL SELECT label, {AT} + i, list_transform(v, lambda x: -x) FROM frames WHERE i < {INSERTED})"""


def _recordings(spark, d):
    by_id = F.row_number().over(sequence.Window.partitionBy("label").orderBy("vec_id")) - 1
    f = table(spark, d, "embeddings").select("label", by_id.alias("i"), F.col("embedding").cast("array<double>").alias("v"))
    # Not as a union: a window over a union of two equally partitioned sides was seen to miss rows of one (Spark 4.1.2).
    kept = F.struct(F.when(F.col("i") < AT, F.col("i")).otherwise(F.col("i") + INSERTED).alias("i"), F.col("v").alias("v"))
    other = F.when(F.col("i") < INSERTED, F.struct((F.col("i") + AT).alias("i"), F.transform("v", lambda x: -x).alias("v")))
    whole = f.select("label", F.inline(F.array_compact(F.array(kept, other))))
    timed = lambda df: df.withColumn("t", (F.col("i") * FRAME_MS).cast("long"))
    return timed(f), timed(whole)


@query
def block_offsets(spark, d):
    source, whole = _recordings(spark, d)
    found = evidence.block_offsets(source, whole, "label", "t", "v", FRAME_MS, margin=5_000, most=20_000)
    return found.withColumn("distance", F.round("distance", 6))


_BLOCKS = f"""{_RECORDINGS}, ends AS (SELECT label, count(*) AS n, CASE WHEN count(*) <= 4 THEN count(*) ELSE least(24, greatest(4, count(*) // 4)) END AS size FROM frames GROUP BY 1),
    reach AS (SELECT e.*, (last_i - (n - 1)) * {FRAME_MS} AS longer FROM ends e JOIN (SELECT label, max(i) AS last_i FROM whole GROUP BY 1) USING (label)),
    lim AS (SELECT *, CAST(floor(greatest(-20000, least(0, longer) - 5000) / {FRAME_MS}) AS BIGINT) AS lo, CAST(ceil(least(20000, greatest(0, longer) + 5000) / {FRAME_MS}) AS BIGINT) AS hi FROM reach),
    centres AS (SELECT label, size, lo, hi, unnest(range(size // 2, n - size // 2, greatest(1, CAST(floor(size / 4 + 0.5) AS BIGINT)))) AS c FROM lim),
    tried AS (SELECT *, unnest(range(lo, hi + 1)) AS o FROM centres),
    sums AS (SELECT t.label, c, o, size, sum(sqrt(list_sum(list_transform(range(1, 65), lambda j: (w.v[j] - f.v[j]) * (w.v[j] - f.v[j]))) / 64)) AS total
               FROM tried t JOIN frames f ON f.label = t.label AND f.i BETWEEN c - size // 2 AND c - size // 2 + size - 1 JOIN whole w ON w.label = t.label AND w.i = f.i + o GROUP BY ALL HAVING count(*) = size), scored AS (SELECT *, total / size AS distance FROM sums),
    found AS (SELECT label, c AS i, c * {FRAME_MS} AS source_ms, arg_min(o, (distance, o)) * {FRAME_MS} AS offset_ms, min(distance) AS distance FROM scored GROUP BY label, c)"""
ORACLE["block_offsets"] = f"WITH {_BLOCKS} SELECT label, i, source_ms, offset_ms, round(distance, 6) AS distance FROM found"


@query
def offset_path(spark, d):
    """Block search, moving median, hysteresis, then runs of equal offset."""
    source, whole = _recordings(spark, d)
    found = evidence.block_offsets(source, whole, "label", "t", "v", FRAME_MS, margin=5_000, most=20_000)
    smooth = sequence.moving_median(found, ["label"], ["i"], "offset_ms", alias="median").drop("offset_ms").withColumnRenamed("median", "offset_ms")
    stable = sequence.stabilise(smooth, ["label"], ["i"], "offset_ms", FRAME_MS, 1_000)
    segs = sequence.segments(stable.withColumn("offset_ms", F.col("stable")), ["label"], ["i"], "source_ms", "offset_ms", "distance")
    return segs.select("label", F.col("run").cast("long").alias("run"), "start_ms", "end_ms", "offset_ms", F.col("n_rows").cast("long").alias("n_rows"))


#: A vector's values in hundredths, and the same after up to seven other values.
SHIFTED = "vec_id % 8"


@query
def refined_boundaries(spark, d):
    s = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 100).cast("int")).alias("s"))
    t = s.withColumn("t", F.expr(f"concat(slice(s, 40, cast({SHIFTED} as int)), s)")).withColumn("at", F.lit(32))
    r = evidence.refine_boundaries(t, "s", "t", "at", "at", rate=1_000, radius=12, window=16)
    return r.select("vec_id", "refined_ms", "shift_ms", "uncertain_from_ms", "uncertain_to_ms", F.round("correlation", 6).alias("correlation"), F.round("margin", 6).alias("margin"), "ambiguous").withColumn("refined_ms", F.col("refined_ms").cast("long"))


ORACLE["refined_boundaries"] = f"""WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 100)) AS s FROM embeddings),
    t AS (SELECT *, list_concat(s[40:39 + {SHIFTED}], s) AS t FROM s),
    w AS (SELECT vec_id, sh, s[25:40] AS x, t[25 + sh:40 + sh] AS y FROM t, (SELECT unnest(range(-12, 13)) AS sh)),
    m AS (SELECT vec_id, sh, list_transform(x, lambda v: v - list_avg(x)) AS x, list_transform(y, lambda v: v - list_avg(y)) AS y FROM w WHERE len(y) = 16),
    c AS (SELECT vec_id, sh, CASE WHEN list_dot_product(x, x) * list_dot_product(y, y) = 0 THEN 0 ELSE list_dot_product(x, y) / sqrt(list_dot_product(x, x) * list_dot_product(y, y)) END AS c FROM m),
    b AS (SELECT *, first_value(sh) OVER o AS bs, first_value(c) OVER o AS bc FROM c WINDOW o AS (PARTITION BY vec_id ORDER BY round(c, 9) DESC, abs(sh), sh)),
    e AS (SELECT *, coalesce(max(sh) FILTER (sh < bs AND c < bc - 0.01) OVER p + 1, min(sh) OVER p) AS l, coalesce(min(sh) FILTER (sh > bs AND c < bc - 0.01) OVER p - 1, max(sh) OVER p) AS r FROM b WINDOW p AS (PARTITION BY vec_id)),
    f AS (SELECT vec_id, bs, bc, l, r, max(c) FILTER (sh < l OR sh > r) AS other FROM e GROUP BY ALL), g AS (SELECT *, greatest(0, bc - coalesce(other, -1)) AS gap FROM f)
    SELECT vec_id, 32 + bs AS refined_ms, bs AS shift_ms, 32 + l AS uncertain_from_ms, 32 + r AS uncertain_to_ms, round(bc, 6) AS correlation, round(gap, 6) AS margin, bc < 0.55 OR gap < 0.01 OR r - l > 120 AS ambiguous FROM g"""

LEAST_POINTS = 8


@query
def holdout_blocks(spark, d):
    return evidence.holdout_blocks(items(spark, d), "user_id", "t_ms", "item_id", LEAST_POINTS, width=DAY)


_TWO64, _U = "18446744073709551616::UHUGEINT", "UHUGEINT"


def _mix(x: str, shift: int, times: int) -> str:
    return f"(xor({x}, {x} // {1 << shift}::{_U}) * {times}::{_U}) % {_TWO64}"


ORACLE["holdout_blocks"] = f"""WITH {_ITEMS}, b AS (SELECT user_id, CAST(floor(t_ms / {DAY}) AS BIGINT) AS block, count(DISTINCT item_id) AS size FROM items GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY block) - 1 AS i, count(*) OVER p AS n, CAST(sum(size) OVER p AS BIGINT) AS total FROM b WINDOW p AS (PARTITION BY user_id)),
    h AS (SELECT *, least(greatest((n + 4) // 5, 2), n - 1, 1024) AS h FROM r WHERE n >= 3 AND total - {LEAST_POINTS} >= 2),
    strata AS (SELECT *, unnest(range(h)) AS slot FROM (SELECT DISTINCT user_id, n, h FROM h)),
    m0 AS (SELECT *, slot * n // h AS a, greatest((slot + 1) * n // h, slot * n // h + 1) AS z, xor(((slot + 1)::{_U} * 11400714819323198485::{_U}) % {_TWO64}, n::{_U} * 131072::{_U}) AS v FROM strata),
    m1 AS (SELECT * REPLACE ({_mix("v", 30, 0xBF58476D1CE4E5B9)} AS v) FROM m0),
    m2 AS (SELECT * REPLACE ({_mix("v", 27, 0x94D049BB133111EB)} AS v) FROM m1),
    place AS (SELECT user_id, a + CAST(xor(v, v // {1 << 31}::{_U}) % (z - a)::{_U} AS BIGINT) AS i FROM m2),
    lists AS (SELECT user_id, any_value(total) AS total, list({{'b': block, 's': size, 'l': 0::BIGINT, 'g': []::BIGINT[]}} ORDER BY block) AS bs FROM h JOIN place USING (user_id, i) GROUP BY 1),
    folded AS (SELECT user_id, list_reduce(list_prepend({{'b': 0::BIGINT, 's': 0::BIGINT, 'l': total, 'g': []::BIGINT[]}}, bs), lambda acc, x: CASE WHEN acc.l - x.s >= {LEAST_POINTS} THEN {{'b': 0::BIGINT, 's': 0::BIGINT, 'l': acc.l - x.s, 'g': list_append(acc.g, x.b)}} ELSE acc END).g AS g FROM lists)
    SELECT user_id, unnest(g) AS block FROM folded WHERE len(g) >= 2"""

WITHIN = 8 * 3_600_000
_EDIT = {
    "source_start_ms": "t_ms", "source_end_ms": "t_ms + (item_id % 7 + 1) * 60000",
    "target_start_ms": "t_ms + item_id % 5 * 1000", "target_end_ms": "t_ms + item_id % 5 * 1000 + (item_id % 7 + 1) * 60000",
}


@query
def greedy_matches(spark, d):
    e = items(spark, d).selectExpr("user_id", "asset_id", "item_id AS event_id", "item_id % 2 AS kind", *[f"{x} AS {n}" for n, x in _EDIT.items()])
    return evidence.greedy_matches(e.filter("asset_id = 'click'"), e.filter("asset_id = 'view'"), "user_id", within=WITHIN)


ORACLE["greedy_matches"] = f"""WITH {_ITEMS}, e AS (SELECT user_id, asset_id, item_id AS id, item_id % 2 AS kind, {", ".join(f"{x} AS {n}" for n, x in _EDIT.items())} FROM items),
    c AS (SELECT g.user_id, g.id AS gid, p.id AS pid, [{", ".join(f"abs(g.{n} - p.{n})" for n in _EDIT)}] AS er, g.kind <> p.kind AS other, g.source_start_ms AS g1, g.target_start_ms AS g2, p.source_start_ms AS p1, p.target_start_ms AS p2
          FROM e g JOIN e p ON g.user_id = p.user_id AND g.asset_id = 'click' AND p.asset_id = 'view'),
    n AS (SELECT *, list_max(er) AS mx, CAST(list_sum(er) AS BIGINT) AS tot FROM c WHERE list_max(er) <= {WITHIN}),
    l AS (SELECT user_id, list({{'g': gid, 'p': pid, 'gs': []::BIGINT[], 'ps': []::BIGINT[]}} ORDER BY mx, tot, other, g1, g2, gid, p1, p2, pid) AS xs FROM n GROUP BY 1),
    f AS (SELECT user_id, list_reduce(list_prepend({{'g': 0::BIGINT, 'p': 0::BIGINT, 'gs': []::BIGINT[], 'ps': []::BIGINT[]}}, xs), lambda a, x: CASE WHEN list_contains(a.gs, x.g) OR list_contains(a.ps, x.p) THEN a ELSE {{'g': 0::BIGINT, 'p': 0::BIGINT, 'gs': list_append(a.gs, x.g), 'ps': list_append(a.ps, x.p)}} END) AS r FROM l),
    u AS (SELECT user_id, unnest(r.gs) AS gid, unnest(r.ps) AS pid FROM f)
    SELECT user_id, gid AS gold_id, pid AS predicted_id, mx AS max_error_ms, tot AS total_error_ms, other AS other_kind FROM u JOIN n USING (user_id, gid, pid)"""

#: Metrics of one time map for each order, in terms that both dialects read alike.
METRICS = {
    "probability": "CASE WHEN k % 37 = 0 THEN NULL ELSE CAST(990 + k % 12 AS DOUBLE) / 1000 END",
    "coverage": "CASE WHEN k % 41 = 0 THEN NULL ELSE CAST(100 - k * 7 % 29 * (k % 4) AS DOUBLE) / 100 END",
    "unique_coverage": "CASE WHEN k % 43 = 0 THEN NULL ELSE CAST(95 - k % 3 * 10 AS DOUBLE) / 100 END",
    "p50_residual_ms": "k % 17",
    "p95_residual_ms": "CASE WHEN k % 47 = 0 THEN NULL WHEN k % 9 = 0 THEN k % 2600 ELSE 10 + k % 90 END",
    "p99_residual_ms": "120 + k % 3 * 180 + CASE WHEN k % 9 = 0 THEN 2600 ELSE 0 END",
    "max_residual_ms": "CASE WHEN k % 53 = 0 THEN 100 ELSE 4000 END",
    "boundary_uncertainty_ms": "CASE WHEN k % 19 = 0 THEN 6000 ELSE k % 5 * 60 END",
    "alternative_margin": "CAST(k % 23 + 20 AS DOUBLE) / 60 - CASE WHEN k % 29 = 0 THEN CAST(3 AS DOUBLE) / 10 ELSE 0 END",
    "anchors": "28 + k % 20",
    "regions": "CASE WHEN k % 31 = 0 THEN 2 ELSE 3 END",
    "held_out": "CASE WHEN k % 59 = 0 THEN 0 ELSE 5 + k % 10 END",
    "evidence_held_out": "CASE WHEN k % 59 = 0 THEN 0 ELSE 5 + k % 10 END",
    "audio_anchors": "k % 6", "visual_anchors": "k % 7",
}
_WORDS = {
    "metric_source": "CASE WHEN k % 13 = 0 THEN 'estimated' ELSE 'measured' END",
    "source_stream": "CASE k % 3 WHEN 0 THEN 'audio' WHEN 1 THEN 'video' ELSE NULL END",
    "target_stream": "CASE WHEN k % 10 = 0 THEN 'video' ELSE CASE k % 3 WHEN 0 THEN 'audio' WHEN 1 THEN 'video' ELSE NULL END END",
}
_KINDS = (("audio", "k % 4 <> 1"), ("visual", "k % 5 <> 1"), ("manual", "k % 6 = 1"))


@query
def map_quality(spark, d):
    """Quality of one time map for each order, and what becomes of the level that it declares."""
    k = table(spark, d, "orders").selectExpr("o_orderkey AS k")
    m = k.selectExpr("k", *[f"{x} AS {n}" for n, x in (METRICS | _WORDS).items()], f"filter(array({', '.join(f'CASE WHEN {c} THEN {e!r} END' for e, c in _KINDS)}), x -> x IS NOT NULL) AS evidence")
    declared = F.get(F.array(*[F.lit(x) for x in ("verified", "review", "blocked", "legacy-unverified")]), (F.col("k") % 4).cast("int"))
    q = evidence.map_quality(m)
    return q.select("k", "level", "complete", F.concat_ws(",", "reasons").alias("reasons"), evidence.reconciled_level(declared, F.col("level")).alias("reconciled"))


def _share(n: str) -> str:
    return f"CASE WHEN {n} < 0 OR {n} > 1 THEN '{n}' END"


_RESIDUALS = ("p50_residual_ms", "p95_residual_ms", "p99_residual_ms", "max_residual_ms")
ORACLE["map_quality"] = f"""WITH m AS (SELECT k, {", ".join(f"{x} AS {n}" for n, x in (METRICS | _WORDS).items())}, {", ".join(f"{c} AS {e}" for e, c in _KINDS)} FROM (SELECT o_orderkey AS k FROM orders)),
    c AS (SELECT *, concat_ws(',', {_share("probability")}, {_share("coverage")}, {_share("unique_coverage")}, {_share("alternative_margin")}, CASE WHEN held_out > anchors THEN 'held_out' END,
                 {", ".join(f"CASE WHEN {a} > {b} THEN '{a}>{b}' END" for a, b in zip(_RESIDUALS, _RESIDUALS[1:]))}) AS bad,
            concat_ws(',', CASE WHEN coverage < 0.2 THEN 'coverageLow' END, CASE WHEN p95_residual_ms > 2000 THEN 'residualHigh' END, CASE WHEN boundary_uncertainty_ms > 5000 THEN 'boundaryWide' END, CASE WHEN alternative_margin < 0.02 THEN 'marginLow' END) AS failed,
            concat_ws(',', CASE WHEN audio AND audio_anchors <= 0 THEN 'audioAnchors' END, CASE WHEN visual AND visual_anchors <= 0 THEN 'visualAnchors' END,
                 CASE WHEN (audio OR visual) AND NOT coalesce(source_stream = target_stream AND CASE source_stream WHEN 'audio' THEN audio ELSE visual END, FALSE) THEN 'streams' END) AS integrity,
            held_out > 0 AND probability IS NOT NULL AND coverage IS NOT NULL AND p95_residual_ms IS NOT NULL AS known, manual OR audio AND visual AS independent, metric_source = 'measured' AS measured FROM m),
    v AS (SELECT *, bad = '' AND known AS complete, coalesce(measured AND independent AND integrity = '' AND probability >= 0.995 AND coverage >= 0.9 AND p95_residual_ms <= 100 AND p99_residual_ms <= 500 AND boundary_uncertainty_ms <= 250
                 AND alternative_margin >= 0.25 AND anchors >= 30 AND regions >= 3 AND unique_coverage >= 0.8, FALSE) AS good,
            concat_ws(',', CASE WHEN NOT measured THEN 'notMeasured' END, CASE WHEN NOT independent THEN 'oneEvidence' END, CASE WHEN probability < 0.995 THEN 'probabilityLow' END, CASE WHEN integrity <> '' THEN integrity END) AS short FROM c),
    l AS (SELECT *, CASE WHEN bad <> '' OR NOT (audio OR visual OR manual) OR failed <> '' THEN 'blocked' WHEN complete AND good THEN 'verified' ELSE 'review' END AS level FROM v)
    SELECT k, level, complete, CASE WHEN bad <> '' THEN bad WHEN NOT (audio OR visual OR manual) THEN 'noEvidence' WHEN failed <> '' THEN failed WHEN NOT complete THEN 'incomplete' WHEN good THEN 'verified'
             WHEN coverage >= 0.7 AND p95_residual_ms <= 400 AND boundary_uncertainty_ms <= 1000 AND alternative_margin >= 0.1 THEN CASE WHEN short <> '' THEN short ELSE 'usable' END ELSE 'unverified' END AS reasons,
           CASE k % 4 WHEN 2 THEN 'blocked' WHEN 3 THEN 'legacy-unverified' WHEN 1 THEN CASE level WHEN 'blocked' THEN 'blocked' ELSE 'review' END ELSE level END AS reconciled FROM l"""
