"""Queries and SQL for season merging, review and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import intervals, merge, review, stats, timeline
from ..sources import lists
from . import fixtures as L
from .oracle import _ITEMS, _MS, ORACLE
from .queries import items, query, table

DAY = L.DAY
MERGE_FILES = L.Literal(
    "files",
    "asset_id string, file_name string, source_order long",
    (("click", "01 - 第一季第1-3集.xml", 0), ("view", "S01E02.xml", 1), ("purchase", "第4.1.xml", 2), ("signup", "第4.2.xml", 3), ("error", "特别篇.xml", 4)),
)
#: What the names of MERGE_FILES say, written by hand for the SQL.
PARSED = L.Literal(
    "parsed",
    "asset_id string, file_name string, source_order long, season long, a long, z long, own_part long",
    (("click", "01 - 第一季第1-3集.xml", 0, 1, 1, 3, None), ("view", "S01E02.xml", 1, 1, 2, 2, None), ("purchase", "第4.1.xml", 2, None, 4, 4, 1), ("signup", "第4.2.xml", 3, None, 4, 4, 2), ("error", "特别篇.xml", 4, None, 5, 5, None)),
)
KNOWN = L.Literal("known", "place long, season long, episode long, duration_ms long", ((0, 1, 1, 700), (1, None, 2, 800), (2, 1, 3, 0), (3, 2, 3, 900), (4, 1, 4, 1000), (5, None, 5, 1100)))
RANGES = L.Literal("ranges", "asset_id string, season long, episode_start long, episodes long", (("own", 1, 1, 2), ("place", None, 3, 3), ("first", 1, 2, 2), ("short", 9, 1, 9), ("late", None, 4, 2)))


def _merged(spark, d):
    return merge.merge_plan(items(spark, d).select("asset_id", "item_id", "t_ms", "original_index"), MERGE_FILES.df(spark), L.STEPS.df(spark))


def _season(df):
    return df.withColumn("season", F.coalesce("season", F.lit(-1)).cast("long")).withColumn("episode", F.col("episode").cast("long"))


_MERGE = f"""{_ITEMS}, {PARSED.cte()}, {L.STEPS.cte()},
    timed AS (SELECT i.*, t_ms + CAST(coalesce((SELECT sum(target_gap_ms) FROM steps WHERE source_at_ms <= t_ms), 0) AS BIGINT) AS mapped_ms FROM items i),
    ends AS (SELECT p.asset_id, z - a + 1 AS n, min(mapped_ms) AS lo, max(mapped_ms) AS hi FROM timed JOIN parsed p USING (asset_id) WHERE z > a GROUP BY ALL),
    borders AS (SELECT *, lo + greatest(1, hi - lo)::DOUBLE / n * k AS expected, greatest(1, hi - lo)::DOUBLE / n * 0.35 AS reach FROM (SELECT *, unnest(range(1, n)) AS k FROM ends)),
    pairs AS (SELECT asset_id, mapped_ms AS l, lead(mapped_ms) OVER (PARTITION BY asset_id ORDER BY mapped_ms) AS r FROM timed),
    scored AS (SELECT b.asset_id, k, (l + r) / 2.0::DOUBLE AS m, row_number() OVER (PARTITION BY b.asset_id, k ORDER BY r - l - abs((l + r) / 2.0::DOUBLE - expected) * 0.2::DOUBLE DESC, l) AS nth
               FROM borders b JOIN pairs p ON p.asset_id = b.asset_id AND r - l >= 60000 AND abs((l + r) / 2.0::DOUBLE - expected) <= reach),
    edges AS (SELECT b.asset_id, b.k, greatest(0, CAST(floor(coalesce(m, expected) + 0.5) AS BIGINT)) AS t FROM borders b LEFT JOIN scored s ON s.asset_id = b.asset_id AND s.k = b.k AND s.nth = 1
              UNION ALL SELECT asset_id, 0, lo FROM ends UNION ALL SELECT asset_id, n, hi + 1 FROM ends),
    parts AS (SELECT asset_id, k + 1 AS part, t AS start_ms, lead(t) OVER (PARTITION BY asset_id ORDER BY k) AS end_ms FROM edges),
    segs0 AS (SELECT p.asset_id, p.file_name, p.source_order, p.season, p.a + s.part - 1 AS episode, s.part, s.start_ms, s.end_ms FROM parts s JOIN parsed p USING (asset_id) WHERE s.end_ms IS NOT NULL
              UNION ALL SELECT p.asset_id, p.file_name, p.source_order, p.season, p.a, p.own_part, arg_min(mapped_ms, t_ms), NULL FROM timed JOIN parsed p USING (asset_id) WHERE p.a = p.z GROUP BY ALL),
    placed AS (SELECT t.item_id, t.asset_id, t.t_ms, s.season, s.episode, greatest(0, mapped_ms - s.start_ms) AS local_ms FROM timed t JOIN segs0 s ON s.asset_id = t.asset_id AND (s.end_ms IS NULL OR mapped_ms >= s.start_ms AND mapped_ms < s.end_ms)),
    filled AS (SELECT asset_id, episode, max(local_ms) AS last_ms, count(*) AS n_items FROM placed GROUP BY ALL),
    segs AS (SELECT s.*, last_ms, coalesce(n_items, 0) AS n_items, CAST(coalesce(sum(coalesce(end_ms - start_ms, last_ms, 0)) OVER (PARTITION BY season, s.episode ORDER BY source_order, coalesce(part, 0), file_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_ms
             FROM segs0 s LEFT JOIN filled f ON f.asset_id = s.asset_id AND f.episode = s.episode),
    entries AS (SELECT p.*, local_ms + offset_ms AS final_ms FROM placed p JOIN segs s ON s.asset_id = p.asset_id AND s.episode = p.episode)"""


@query
def batch_merge_plan(spark, d):
    return _season(_merged(spark, d)[1]).select("season", "episode", "item_id", "asset_id", "final_ms")


ORACLE["batch_merge_plan"] = f"WITH {_MERGE} SELECT coalesce(season, -1) AS season, episode, item_id, asset_id, final_ms FROM entries"


@query
def batch_merge_segments(spark, d):
    return _season(_merged(spark, d)[0]).select("asset_id", "season", "episode", F.coalesce("part", F.lit(-1)).cast("long").alias("part"), "start_ms", F.coalesce("duration_ms", F.lit(-1)).alias("duration_ms"), "n_items", "offset_ms")


ORACLE["batch_merge_segments"] = f"WITH {_MERGE} SELECT asset_id, coalesce(season, -1) AS season, episode, coalesce(part, -1) AS part, start_ms, coalesce(end_ms - start_ms, -1) AS duration_ms, n_items, offset_ms FROM segs"


@query
def batch_merge_episodes(spark, d):
    return _season(merge.merged_episodes(_merged(spark, d)[0])).withColumn("place", F.col("place").cast("long"))


ORACLE["batch_merge_episodes"] = f"""WITH {_MERGE}, e AS (SELECT season, episode, count(DISTINCT file_name) AS n_files, CAST(sum(n_items) AS BIGINT) AS n_items FROM segs GROUP BY ALL)
    SELECT row_number() OVER (ORDER BY coalesce(season, 0), episode) AS place, coalesce(season, -1) AS season, episode,
           CASE WHEN (SELECT count(DISTINCT season) FROM segs) > 1 AND season IS NOT NULL THEN printf('S%02dE%02d.xml', season, episode) ELSE printf('%d - %d.xml', episode, episode) END AS file_name, n_files, n_items FROM e"""


@query
def merge_compensation(spark, d):
    return merge.compensation(_merged(spark, d)[1], L.STEPS.df(spark))


ORACLE["merge_compensation"] = f"""WITH {_MERGE}, moved AS (SELECT e.* FROM entries e WHERE coalesce((SELECT sum(target_gap_ms) FROM steps WHERE source_at_ms <= e.t_ms), 0) <> 0)
    SELECT (SELECT count(*) FROM steps) AS n_markers, (SELECT CAST(sum(target_gap_ms) AS BIGINT) FROM steps) AS total_gap_ms, count(*) AS n_entries, count(DISTINCT (coalesce(season, -1), episode)) AS n_episodes FROM moved"""


@query
def range_durations(spark, d):
    return merge.range_durations(RANGES.df(spark), KNOWN.df(spark)).select("asset_id", F.col("k").cast("long").alias("k"), "duration_ms", "rule")


ORACLE["range_durations"] = f"""WITH {RANGES.cte()}, {KNOWN.cte()}, want AS (SELECT *, unnest(range(episodes)) AS k FROM ranges),
    own AS (SELECT asset_id, k, episodes, (SELECT arg_min(CASE WHEN duration_ms > 0 THEN duration_ms ELSE -1 END, place) FROM known n WHERE n.episode = w.episode_start + w.k AND (n.season IS NULL OR w.season IS NULL OR n.season = w.season)) AS d, 'number' AS rule FROM want w),
    placed AS (SELECT w.asset_id, row_number() OVER (PARTITION BY asset_id ORDER BY k) - 1 AS k, episodes, n.duration_ms AS d, 'place' AS rule FROM want w JOIN known n ON n.place = w.episode_start + w.k - 1 WHERE w.season IS NULL AND n.duration_ms > 0),
    listed AS (SELECT row_number() OVER (ORDER BY place) - 1 AS k, duration_ms AS d FROM known WHERE duration_ms > 0),
    fst AS (SELECT asset_id, k, episodes, d, 'first' AS rule FROM want JOIN listed USING (k)),
    every AS (SELECT * FROM own WHERE d > 0 UNION ALL SELECT * FROM placed UNION ALL SELECT * FROM fst),
    chosen AS (SELECT asset_id, arg_min(rule, CASE rule WHEN 'number' THEN 0 WHEN 'place' THEN 1 ELSE 2 END) AS rule FROM (SELECT asset_id, rule FROM every GROUP BY asset_id, rule, episodes HAVING count(*) >= episodes OR rule = 'first') GROUP BY asset_id)
    SELECT asset_id, k, d AS duration_ms, rule FROM every JOIN chosen USING (asset_id, rule)"""


@query
def quiet_gaps(spark, d):
    return merge.quiet_gaps(items(spark, d), "asset_id", "t_ms", 600_000)


ORACLE["quiet_gaps"] = f"WITH {_ITEMS}, p AS (SELECT asset_id, t_ms AS left_ms, lead(t_ms) OVER (PARTITION BY asset_id ORDER BY t_ms) AS right_ms FROM items) SELECT * FROM p WHERE right_ms - left_ms >= 600000"


def _anchors(spark, d):
    return items(spark, d).select("item_id", F.col("t_ms").alias("source_ms"), (F.col("t_ms") + F.col("item_id") % 5 * 1000).alias("target_ms"))


@query
def applied_anchors(spark, d):
    return review.applied_anchors(_anchors(spark, d), _anchors(spark, d).filter("item_id % 3 = 0")).select("item_id")


ORACLE["applied_anchors"] = f"WITH {_ITEMS}, a AS (SELECT item_id, t_ms AS s, t_ms + item_id % 5 * 1000 AS t FROM items) SELECT item_id FROM a WHERE (s, t) IN (SELECT (s, t) FROM a WHERE item_id % 3 = 0)"


@query
def applied_cuts(spark, d):
    its = items(spark, d)
    proposed = its.select("item_id", (F.col("t_ms") - DAY + 0.5).alias("source_at_ms"), (F.col("item_id") % 7 + 0.25).alias("target_gap_ms"))
    markers = its.filter("item_id % 4 = 1").select((F.greatest(F.lit(0), F.col("t_ms") - DAY + 1)).alias("source_at_ms"), (F.col("item_id") % 7).alias("target_gap_ms"))
    return review.applied_cuts(proposed, markers).select("item_id")


ORACLE["applied_cuts"] = f"WITH {_ITEMS} SELECT item_id FROM items WHERE (greatest(0, t_ms - {DAY} + 1), item_id % 7) IN (SELECT (greatest(0, t_ms - {DAY} + 1), item_id % 7) FROM items WHERE item_id % 4 = 1)"


@query
def selected_range(spark, d):
    return review.selected(items(spark, d).withColumnRenamed("t_ms", "final_ms"), 9 * DAY, 5 * DAY)


ORACLE["selected_range"] = f"WITH {_ITEMS} SELECT DISTINCT item_id FROM items WHERE enabled AND t_ms BETWEEN {5 * DAY} AND {9 * DAY}"


@query
def zoom_slider(spark, d):
    zoom = F.col("value") * F.col("value") / 7 - 1
    return items(spark, d).select("item_id", review.zoom_to_slider(zoom).alias("slider"), F.round(review.slider_to_zoom(F.col("item_id") % 1200 - 100), 4).alias("zoom"))


ORACLE["zoom_slider"] = f"""WITH {_ITEMS} SELECT item_id, CAST(floor((ln(least(1600, greatest(0.01, value * value / 7 - 1))) - ln(0.01)) / (ln(1600) - ln(0.01)) * 1000 + 0.5) AS BIGINT) AS slider,
    round(exp(ln(0.01) + (ln(1600) - ln(0.01)) * (least(1000, greatest(0, item_id % 1200 - 100)) / 1000)), 4) AS zoom FROM items"""


@query
def pair_plan(spark, d):
    c, s = table(spark, d, "nation"), table(spark, d, "supplier")
    return review.pair_plan(c.select(F.col("n_nationkey").alias("source_id")), s.select(F.col("s_suppkey").alias("target_id")))


ORACLE["pair_plan"] = "SELECT source_id, target_id, tile_row, tile_column FROM (SELECT n_nationkey AS source_id, (row_number() OVER (ORDER BY n_nationkey) - 1) // 256 AS tile_row FROM nation), (SELECT s_suppkey AS target_id, (row_number() OVER (ORDER BY s_suppkey) - 1) // 256 AS tile_column FROM supplier)"


@query
def checked_pairs(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("place"), F.format_string(" c%d", F.col("o_custkey")).alias("source_id"), F.format_string("t%d ", F.col("o_orderkey") % 3).alias("target_id"))
    known = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.format_string("c%d", "c_custkey").alias("source_id"))
    return review.checked_pairs(o, known, spark.createDataFrame([("t0",), ("t1",)], "target_id string")).withColumn("problem", F.coalesce("problem", F.lit("")))


ORACLE["checked_pairs"] = """WITH p AS (SELECT o_orderkey AS place, 'c' || o_custkey AS source_id, 't' || (o_orderkey % 3) AS target_id, o_custkey FROM orders)
    SELECT place, source_id, target_id, CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) OR target_id NOT IN ('t0', 't1') THEN 'unknownMedia' WHEN row_number() OVER (PARTITION BY source_id, target_id ORDER BY place) > 1 THEN 'duplicate' ELSE '' END AS problem FROM p"""


@query
def review_queue(spark, d):
    q = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "blocked").when(F.col("o_orderstatus") == "P", "attention").otherwise("info").alias("severity"), (F.col("o_custkey") % 100).alias("source_at_ms"), F.when(F.col("o_orderkey") % 2 == 0, "anchor").otherwise("cut").alias("kind"))
    return review.review_queue(q).select("id", F.col("place").cast("long").alias("place"))


ORACLE["review_queue"] = "SELECT o_orderkey AS id, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_custkey % 100, CASE WHEN o_orderkey % 2 = 0 THEN 'anchor' ELSE 'cut' END, o_orderkey) AS place FROM orders"


@query
def numeric_order(spark, d):
    s = table(spark, d, "supplier").select(F.concat(F.lit("EP "), F.col("s_suppkey"), F.lit(" part "), F.col("s_suppkey") % 13).alias("label"), "s_suppkey")
    return s.select("s_suppkey", review.numeric_key(F.col("label")).alias("sort_key"))


ORACLE["numeric_order"] = "SELECT s_suppkey, 'EP ' || lpad(CAST(s_suppkey AS VARCHAR), 20, '0') || ' part ' || lpad(CAST(s_suppkey % 13 AS VARCHAR), 20, '0') AS sort_key FROM supplier"


@query
def evidence_ladder(spark, d):
    e = items(spark, d).groupBy("user_id").agg(F.count("*").alias("frames"), F.count_if("enabled").alias("matched"), F.count_if(F.col("value") >= 8).alias("strong"), F.count_if(F.col("value").between(5, 8)).alias("weak"))
    regions = review.low_confidence_regions(F.col("matched"), F.col("frames"))
    return e.select("user_id", regions.alias("regions"), review.evidence_quality(F.col("matched") / F.col("frames"), F.col("strong"), F.col("weak"), regions).alias("quality"))


ORACLE["evidence_ladder"] = f"""WITH {_ITEMS}, e AS (SELECT user_id, count(*) AS f, count(*) FILTER (enabled) AS m, count(*) FILTER (value >= 8) AS s, count(*) FILTER (value BETWEEN 5 AND 8) AS w FROM items GROUP BY 1),
    r AS (SELECT *, CASE WHEN f <= m THEN 0 ELSE CAST(ceil((f - m) / 5) AS BIGINT) END AS regions FROM e)
    SELECT user_id, regions, CASE WHEN m = 0 OR regions >= 6 THEN 'blocked' WHEN m / f >= 0.75 AND s >= w AND regions <= 1 THEN 'high' WHEN m / f >= 0.45 AND regions <= 3 THEN 'medium' ELSE 'low' END AS quality FROM r"""


@query
def visual_evidence(spark, d):
    a = items(spark, d).select("asset_id", "t_ms", "item_id", F.when(F.col("item_id") % 11 != 0, F.round(F.col("value") / 50, 3)).alias("distance"))
    return review.visual_evidence(a, "asset_id", ["t_ms", "item_id"])


ORACLE["visual_evidence"] = f"""WITH {_ITEMS}, a AS (SELECT asset_id, CASE WHEN item_id % 11 <> 0 THEN round(value / 50, 3) END AS x, row_number() OVER (PARTITION BY asset_id ORDER BY t_ms, item_id) - 1 AS i, count(*) OVER (PARTITION BY asset_id) AS n FROM items)
    SELECT asset_id, count(*) AS n_observations, count(*) FILTER (x <= 0.16) AS n_supported, avg(x) AS mean_distance, count(*) FILTER (x <= 0.16) / count(*) AS support_ratio FROM a WHERE x IS NOT NULL AND i % greatest(1, n // 160) = 0 GROUP BY 1"""


@query
def preferred_streams(spark, d):
    s = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("stream_index"), (F.col("l_returnflag") == "R").alias("is_commentary"), (F.col("l_linestatus") == "F").alias("is_default"))
    return review.preferred_streams(s, "l_orderkey")


ORACLE["preferred_streams"] = "SELECT l_orderkey, CAST(stream_index AS BIGINT) AS stream_index FROM (SELECT l_orderkey, l_linenumber AS stream_index, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag = 'R', l_linestatus <> 'F', l_linenumber) AS n FROM lineitem) WHERE n = 1"


@query
def canonical_landmarks(spark, d):
    m = items(spark, d).select("user_id", F.col("item_id").alias("landmark_id"), F.floor(F.col("t_ms") / DAY).alias("time_ms"), (F.col("item_id") % 5).alias("hash"), (F.col("item_id") % 3).alias("strength_milli"))
    return review.canonical_landmarks(m, "user_id").select("landmark_id", F.col("place").cast("long").alias("place"))


ORACLE["canonical_landmarks"] = f"WITH {_ITEMS} SELECT item_id AS landmark_id, row_number() OVER (PARTITION BY user_id ORDER BY t_ms // {DAY}, item_id % 5, item_id % 3 DESC, item_id) AS place FROM items"


def _spans(spark, d, odd):
    s = table(spark, d, "events").filter(F.col("event_id") % 2 == odd)
    return s.select("user_id", X.event_ms(F.col("ts")).alias("start_ms"), (X.event_ms(F.col("ts")) + (F.col("event_id") % 7 + 1) * DAY).alias("end_ms"))


@query
def largest_overlap(spark, d):
    return review.largest_overlap(_spans(spark, d, 0), _spans(spark, d, 1), "user_id")


ORACLE["largest_overlap"] = f"""WITH s AS (SELECT user_id, event_id, {_MS} AS a, {_MS} + (event_id % 7 + 1) * {DAY} AS z FROM events)
    SELECT l.user_id, greatest(0, coalesce(max(least(l.z, r.z) - greatest(l.a, r.a)), 0)) AS overlap_ms FROM s l LEFT JOIN s r ON l.user_id = r.user_id AND r.event_id % 2 = 1 WHERE l.event_id % 2 = 0 GROUP BY 1"""


@query
def playback_counterpart(spark, d):
    p = items(spark, d).join(L.SPANS.df(spark).filter("kind = 'matched'").withColumnRenamed("map_id", "asset_id"), "asset_id")
    s, e, ts, te = (F.col(c) for c in ("source_start_ms", "source_end_ms", "target_start_ms", "target_end_ms"))
    on_target = review.counterpart(F.col("t_ms"), s, e, ts, te)
    context = review.boundary_context(s, F.lit(2 * DAY), F.lit(9 * DAY), 3000)
    return p.select("item_id", "span_index", F.coalesce(on_target, F.lit(-1)).alias("target_ms"), F.coalesce(review.counterpart(on_target, ts, te, s, e), F.lit(-1)).alias("back_ms"), context["start_ms"].alias("from_ms"), context["end_ms"].alias("to_ms"))


def _other(at: str, a: str, z: str, ta: str, tz: str) -> str:
    return f"CASE WHEN {z} > {a} AND {tz} > {ta} AND {at} >= {a} AND {at} < {z} THEN least({tz} - 1, {ta} + CAST((2 * CAST({at} - {a} AS HUGEINT) * ({tz} - {ta}) + ({z} - {a})) // (2 * ({z} - {a})) AS BIGINT)) END"


ORACLE["playback_counterpart"] = f"""WITH {_ITEMS}, {L.SPANS.cte()}, h AS (SELECT item_id, span_index, t_ms, source_start_ms AS a, source_end_ms AS z, target_start_ms AS ta, target_end_ms AS tz FROM items JOIN spans ON map_id = asset_id AND kind = 'matched'),
    o AS (SELECT *, {_other("t_ms", "a", "z", "ta", "tz")} AS x, least({9 * DAY}, greatest({2 * DAY}, a)) AS b FROM h)
    SELECT item_id, span_index, coalesce(x, -1) AS target_ms, coalesce({_other("x", "ta", "tz", "a", "z")}, -1) AS back_ms, greatest({2 * DAY}, b - 3000) AS from_ms, least({9 * DAY}, b + 3000) AS to_ms FROM o"""


@query
def affine_windows(spark, d):
    i, c = F.col("item_id"), F.col
    h = items(spark, d).select(
        "item_id", ((i % 9 - 1) / 4).alias("scale"), (i % 101 * 10 - 500).alias("offset_ms"), (c("t_ms") % 5000).alias("support_start_ms"), (c("t_ms") % 5000 + i % 700).alias("support_end_ms"),
        (c("t_ms") % 9000).alias("query_start_ms"), (c("t_ms") % 9000 + i % 900).alias("query_end_ms"), F.lit(100).alias("source_min_ms"), F.lit(6000).alias("source_max_ms"), F.lit(0).alias("target_min_ms"), F.lit(8000).alias("target_max_ms"), (i % 5 * 50).alias("source_guard_ms"), (i % 3 * 40).alias("target_guard_ms"),
    )
    return review.affine_windows(h).select("item_id", *[F.coalesce(c(n).cast("long"), F.lit(-1)).alias(n) for n in ("source_start_ms", "source_end_ms", "target_start_ms", "target_end_ms")])


ORACLE["affine_windows"] = f"""WITH {_ITEMS}, h AS (SELECT item_id, (item_id % 9 - 1) / 4 AS k, item_id % 101 * 10 - 500 AS o, t_ms % 5000 AS s1, t_ms % 5000 + item_id % 700 AS s2, t_ms % 9000 AS q1, t_ms % 9000 + item_id % 900 AS q2, item_id % 5 * 50 AS sg, item_id % 3 * 40 AS tg FROM items),
    t AS (SELECT *, greatest(greatest(q1, 0) - tg, 0) AS t1, least(least(q2, 8000) + tg, 8000) AS t2 FROM h WHERE k > 0 AND least(q2, 8000) > greatest(q1, 0)),
    w AS (SELECT *, greatest(100, least(CAST(floor((t1 - o) / k - sg) AS BIGINT), s1 - sg)) AS a, least(6000, greatest(CAST(ceil((t2 - o) / k + sg) AS BIGINT), s2 + sg)) AS z FROM t)
    SELECT i.item_id, coalesce(a, -1) AS source_start_ms, coalesce(z, -1) AS source_end_ms, CASE WHEN a IS NULL THEN -1 ELSE t1 END AS target_start_ms, CASE WHEN a IS NULL THEN -1 ELSE t2 END AS target_end_ms FROM items i LEFT JOIN (SELECT * FROM w WHERE z > a) w USING (item_id)"""


@query
def spectral_block_score(spark, d):
    """Blocks of six frames of twelve bands from the vectors: each block with the one of the next label."""
    e = table(spark, d, "embeddings").select((F.col("vec_id") / 6).cast("long").alias("block"), "vec_id", F.struct((F.abs(F.get("embedding", F.lit(20))) * 3000).cast("long").alias("active"), F.transform(F.slice("embedding", 1, 12), lambda x: F.floor(F.abs(x.cast("double")) * 100).cast("double")).alias("v")).alias("f"))
    blocks = e.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "f"))), lambda x: x["f"]).alias("fs"))
    pairs = blocks.join(blocks.select((F.col("block") - 1).alias("block"), F.col("fs").alias("gs")), "block").filter("size(fs) = size(gs)")
    return pairs.select("block", F.round(review.spectral_block_score(F.col("fs"), F.col("gs")), 9).alias("score"))


ORACLE["spectral_block_score"] = """WITH f AS (SELECT vec_id // 6 AS block, vec_id % 6 AS k, CAST(trunc(abs(embedding[21]) * 3000) AS BIGINT) AS act, list_transform(embedding[1:12], lambda x: floor(abs(CAST(x AS DOUBLE)) * 100)) AS v FROM embeddings),
    p AS (SELECT a.block, a.k, a.act AS xa, b.act AS ya, a.v AS x, b.v AS y, a.act >= 100 AND b.act >= 100 AS live FROM f a JOIN f b ON b.block = a.block + 1 AND b.k = a.k),
    q AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0, coalesce(lag(live) OVER w, FALSE) AS live0 FROM p WINDOW w AS (PARTITION BY block ORDER BY k)),
    r AS (SELECT *, list_dot_product(x, x) AS xx, list_dot_product(y, y) AS yy, list_dot_product(x, y) AS xy, list_transform(range(1, 13), lambda i: x[i] - coalesce(x0[i], 0)) AS dx, list_transform(range(1, 13), lambda i: y[i] - coalesce(y0[i], 0)) AS dy FROM q),
    c AS (SELECT *, CASE WHEN xx = 0 OR yy = 0 THEN 0 ELSE least(1, greatest(0, xy / (sqrt(xx) * sqrt(yy)))) END AS plain FROM r),
    e AS (SELECT *, CASE WHEN NOT live0 THEN plain WHEN list_dot_product(dx, dx) = 0 OR list_dot_product(dy, dy) = 0 THEN 0 ELSE least(1, greatest(0, (list_dot_product(dx, dy) / (sqrt(list_dot_product(dx, dx)) * sqrt(list_dot_product(dy, dy))) + 1) * 0.5)) END AS change FROM c),
    s AS (SELECT block, count(*) AS n, count(*) FILTER (live) AS m, sum(plain * 0.6 + change * 0.3 + greatest(0, 1 - abs(xa - ya) / 1000) * 0.1) FILTER (live) AS t FROM e GROUP BY 1),
    z AS (SELECT block, count(*) AS n FROM f GROUP BY 1)
    SELECT s.block, round(CASE WHEN m < ceil(s.n / 2) THEN 0 ELSE t / m * m / s.n END, 9) AS score FROM s JOIN z a ON a.block = s.block JOIN z b ON b.block = s.block + 1 WHERE a.n = b.n"""


@query
def benchmark_scenarios(spark, d):
    i, c = F.col("item_id"), F.col
    none = F.lit(None).cast("long")
    g = items(spark, d).select(
        "item_id", (i % 3 % 2).alias("n_source_only"), F.when(i % 5 == 0, 1).otherwise(0).alias("n_target_only"), F.when(i % 7 == 0, 2).otherwise(0).alias("n_ambiguous"), F.lit(0).alias("source_start_ms"), (i * 7919 % 4_000_000).alias("source_end_ms"), F.when(i % 4 == 0, 500).otherwise(0).alias("target_start_ms"),
        F.when(i % 6 != 0, i).otherwise(none).alias("first_source_ms"), F.when(i % 6 != 0, i + F.when(i % 8 == 0, 3).otherwise(0)).otherwise(none).alias("first_target_ms"), F.when(i % 6 != 0, i + 1000).otherwise(none).alias("last_source_ms"), F.when(i % 6 != 0, i + 1000 + i % 2).otherwise(none).alias("last_target_ms"), (c("mode") == 0).alias("same"),
    )
    return review.benchmark_scenarios(g).select("item_id", F.coalesce("scenarios", F.lit("")).alias("scenarios"))


ORACLE["benchmark_scenarios"] = f"""WITH {_ITEMS}, g AS (SELECT item_id AS i, mode = 0 AS same, item_id % 3 % 2 AS so, CASE WHEN item_id % 5 = 0 THEN 1 ELSE 0 END AS tn, CASE WHEN item_id % 7 = 0 THEN 2 ELSE 0 END AS am FROM items),
    n AS (SELECT i, same, list_filter([CASE WHEN am > 0 THEN 'ambiguous' END, CASE WHEN i % 4 = 0 OR (i % 6 <> 0 AND i % 8 = 0) THEN 'global-offset' END, CASE WHEN i * 7919 % 4000000 >= 2700000 THEN 'long-reference' END, CASE WHEN so + tn + am > 1 THEN 'multi-edit' END,
        CASE WHEN so > 0 THEN 'source-only' END, CASE WHEN tn > 0 THEN 'target-only' END, CASE WHEN so + tn + am = 0 AND i % 6 <> 0 AND (1000 + i % 2) - CASE WHEN i % 8 = 0 THEN 3 ELSE 0 END <> 1000 THEN 'time-stretch' END], lambda x: x IS NOT NULL) AS l FROM g)
    SELECT i AS item_id, CASE WHEN len(l) > 0 THEN array_to_string(l, ',') WHEN NOT same THEN 'codec-variant' ELSE '' END AS scenarios FROM n"""


@query
def resolve_without_disabled(spark, d):
    """Placed items of which every seventh is switched off."""
    its = items(spark, d)
    return timeline.resolve(its, L.CLIPS.df(spark), L.STEPS.df(spark), disabled=its.filter("item_id % 7 = 0").select("item_id")).select("clip_id", "item_id", "enabled", "final_ms")


ORACLE["resolve_without_disabled"] = f"""WITH {_ITEMS}, {L.CLIPS.cte()}, {L.STEPS.cte()},
    p AS (SELECT c.clip_id, i.item_id, i.enabled AND i.item_id % 7 <> 0 AS enabled, c.timeline_start_ms + i.t_ms - c.source_in_ms + c.local_offset_ms AS raw FROM items i JOIN clips c ON i.asset_id = c.asset_id AND c.enabled AND i.t_ms >= c.source_in_ms AND i.t_ms < c.source_out_ms)
    SELECT clip_id, item_id, enabled, raw + CAST(coalesce((SELECT sum(target_gap_ms) FROM steps WHERE source_at_ms <= raw), 0) AS BIGINT) AS final_ms FROM p"""


@query
def nearest_later_frame(spark, d):
    """The nearest frame, of equals the later one; times in whole hours, so that equals are common."""
    it = items(spark, d).withColumn("t_ms", F.floor(F.col("t_ms") / 3_600_000) * 3_600_000)
    frames = it.filter("asset_id = 'view'").select(F.col("item_id").alias("frame"), F.col("t_ms").alias("frame_ms"))
    return intervals.nearest(it.filter("asset_id = 'click'").select("item_id", "t_ms"), frames, "t_ms", "frame_ms", 7_200_000, "item_id", "frame", later_wins=True)


ORACLE["nearest_later_frame"] = f"""WITH {_ITEMS}, h AS (SELECT item_id, asset_id, t_ms // 3600000 * 3600000 AS t FROM items),
    j AS (SELECT a.item_id, b.item_id AS frame_id, abs(a.t - b.t) AS distance, row_number() OVER (PARTITION BY a.item_id ORDER BY abs(a.t - b.t), b.t DESC, b.item_id DESC) AS r FROM h a JOIN h b ON a.asset_id = 'click' AND b.asset_id = 'view' AND b.t BETWEEN a.t - 7200000 AND a.t + 7200000)
    SELECT item_id, frame_id, distance FROM j WHERE r = 1"""


@query
def peaks(spark, d):
    return items(spark, d).groupBy("user_id").agg(F.coalesce(stats.peak(F.when(F.col("item_id") % 50 != 0, F.col("t_ms"))), F.lit(-1)).alias("peak_ms"))


ORACLE["peaks"] = f"WITH {_ITEMS} SELECT user_id, CASE WHEN count(*) FILTER (item_id % 50 = 0) = 0 THEN max(t_ms) ELSE -1 END AS peak_ms FROM items GROUP BY 1"


@query
def zoom_buckets(spark, d):
    return items(spark, d).select("item_id", X.bucket_size_ms(F.col("item_id") % 500).cast("long").alias("bucket_ms"))


ORACLE["zoom_buckets"] = f"WITH {_ITEMS} SELECT item_id, CASE WHEN item_id % 500 < 18 THEN 30000 WHEN item_id % 500 < 45 THEN 10000 WHEN item_id % 500 < 130 THEN 1000 WHEN item_id % 500 < 420 THEN 500 ELSE 100 END AS bucket_ms FROM items"


# Lists as people write them: each user's events in order, a token or line an event, of several forms and some wrong ones.
_A, _B = "event_id % 97", "event_id % 80"
_LISTED = f"e AS (SELECT user_id, event_id AS i, {_A} AS a, {_B} AS b, event_id % 7 AS v FROM events)"


def _written(spark, d, forms, separator):
    e = table(spark, d, "events").withColumns({"a": F.expr(_A).cast("string"), "b": F.expr(_B).cast("string"), "b60": F.expr(f"{_B} % 60").cast("string")})
    told = F.coalesce(*[F.when(F.col("event_id") % 7 == k, F.concat(*[F.col(x[1:]) if x[0] == "$" else F.lit(x) for x in form])) for k, form in enumerate(forms)])
    return e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", told.alias("t")))), lambda x: x["t"]), separator).alias("text"))


@query
def cut_lists(spark, d):
    forms = (("$a", ":", "$b"), ("1:", "$a", ":", "$b"), ("$a",), ("$a", ".25 min"), ("$b", "分"), ("x", "$a"), ("$a", ":", "$b60", ".5"))
    return lists.cut_points(_written(spark, d, forms, "， ;")).select("user_id", F.posexplode("cut_ms").alias("place", "cut_ms"), F.size("not_understood").alias("n_wrong"))


ORACLE["cut_lists"] = f"""WITH {_LISTED}, t AS (SELECT user_id, CASE v WHEN 0 THEN CASE WHEN b < 60 THEN (a * 60 + b) * 1000 END WHEN 1 THEN CASE WHEN a < 60 AND b < 60 THEN (3600 + a * 60 + b) * 1000 END WHEN 2 THEN a * 60000 WHEN 3 THEN a * 60000 + 15000 WHEN 4 THEN b * 60000 WHEN 6 THEN (a * 60 + b % 60) * 1000 + 500 END AS ms FROM e)
    SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ms) - 1 AS place, ms AS cut_ms, n_wrong FROM t JOIN (SELECT user_id, count(*) FILTER (ms IS NULL) AS n_wrong FROM t GROUP BY 1) USING (user_id) WHERE ms IS NOT NULL"""


@query
def anchor_lists(spark, d):
    forms = (("$a", ":", "$b", " -> 1:", "$a", ":05"), ("0:", "$a", ":7,", "$b", ":10"), ("# ", "$a", ":1 -> 1:00"), ("$a", ":", "$b60"), ("$a", " -> ", "$b"), ("$a", ":", "$b60", ".25 → ", "$a", ":", "$b60", ".75"), ("$a", ":10\t1:00 # later"))
    return lists.anchor_lines(_written(spark, d, forms, "\n \n")).withColumn("line", F.col("line").cast("long"))


ORACLE["anchor_lists"] = f"""WITH {_LISTED}, t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY i) AS line, v,
        CASE v WHEN 0 THEN CASE WHEN b < 60 AND a < 60 THEN (a * 60 + b) * 1000 END WHEN 1 THEN CASE WHEN a < 60 THEN (a * 60 + 7) * 1000 END WHEN 5 THEN (a * 60 + b % 60) * 1000 + 250 END AS s,
        CASE v WHEN 0 THEN (3600 + a * 60 + 5) * 1000 WHEN 1 THEN (b * 60 + 10) * 1000 WHEN 5 THEN (a * 60 + b % 60) * 1000 + 750 END AS z FROM e WHERE v <> 2)
    SELECT user_id, line, s AS source_ms, CASE WHEN s IS NOT NULL THEN z END AS target_ms, CASE WHEN v = 3 THEN 'notAPair' WHEN s IS NULL THEN 'badTime' END AS warning FROM t"""


@query
def duration_lists(spark, d):
    forms = (("S3E", "$a", " ", "$a", ":", "$b60"), ("$a", " 1:", "$b60", ":07"), ("第2季第", "$a", "集 = ", "$a", ".5 分钟"), ("nothing",), ("$b",), ("E", "$a", ": ", "$b", "min"), ("ep-", "$a", "=", "$b", ".25"))
    return lists.duration_lines(_written(spark, d, forms, "\r\n")).withColumns({c: F.col(c).cast("long") for c in ("line", "season", "episode")})


ORACLE["duration_lists"] = f"""WITH {_LISTED}, t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY i) AS line, v, a,
        nullif(CASE v WHEN 0 THEN (a * 60 + b % 60) * 1000 WHEN 1 THEN (3600 + b % 60 * 60 + 7) * 1000 WHEN 2 THEN a * 60000 + 30000 WHEN 4 THEN b * 60000 WHEN 5 THEN b * 60000 WHEN 6 THEN b * 60000 + 15000 END, 0) AS ms FROM e)
    SELECT user_id, line, ms AS duration_ms, CASE WHEN ms IS NULL THEN NULL WHEN v = 0 THEN 3 WHEN v = 2 THEN 2 END AS season, CASE WHEN ms IS NULL THEN NULL WHEN v IN (4, 5) THEN line ELSE a END AS episode FROM t"""


@query
def source_timecodes(spark, d):
    e = table(spark, d, "events").select("event_id", F.expr(_A).cast("string").alias("a"), F.expr(_B).cast("string").alias("b"))
    forms = (F.concat("a", F.lit(":"), "b"), F.concat(F.lit(" 2:"), "a", F.lit(":"), "b", F.lit(".5 ")), F.col("a"), F.concat("b", F.lit(".125")), F.concat("b", F.lit(".1234")), F.concat("a", F.lit(":")), F.concat(F.lit("0:0:"), "b"))
    text = F.coalesce(*[F.when(F.col("event_id") % 7 == k, x) for k, x in enumerate(forms)])
    return e.select("event_id", lists.timecode_ms(text).alias("ms"))


ORACLE["source_timecodes"] = f"""WITH {_LISTED} SELECT i AS event_id, CASE v WHEN 0 THEN CASE WHEN a < 60 AND b < 60 THEN (a * 60 + b) * 1000 END WHEN 1 THEN CASE WHEN a < 60 AND b < 60 THEN (7200 + a * 60 + b) * 1000 + 500 END
    WHEN 2 THEN CASE WHEN a < 60 THEN a * 1000 END WHEN 3 THEN CASE WHEN b < 60 THEN b * 1000 + 125 END WHEN 6 THEN CASE WHEN b < 60 THEN b * 1000 END END AS ms FROM e"""

_FILED = f"{_ITEMS}, x AS (SELECT asset_id || '-' || CAST(t_ms // 3600000 % 24 AS VARCHAR) AS a, item_id, t_ms, mode, ' <&> ' || coalesce(text, '') || chr(9) AS text FROM items)"
ORACLE["xml_items"] = f"WITH {_FILED} SELECT a AS asset_id, item_id AS row_id, t_ms, CAST(mode AS BIGINT) AS mode, 'u&<' AS user_hash, text || CASE WHEN length(a) % 3 = 2 THEN ' more' ELSE '' END AS text FROM x"
ORACLE["xml_roundtrip"] = f"WITH {_FILED} SELECT a AS asset_id, count(*) AS n_items, count(*) AS n_same FROM x GROUP BY a"
_U = "CAST({} AS UHUGEINT)"
_WRAP = "CAST({} % 18446744073709551616 AS UBIGINT)"
_MIXED = [f"xor(CAST(family AS UBIGINT), CAST(ordinal AS UBIGINT) << 17)"]
_MIXED.append(_WRAP.format(f"({_U.format('v')} + CAST(11400714819323198485 AS UHUGEINT))"))
_MIXED.append(_WRAP.format(f"({_U.format('xor(v, v >> 30)')} * CAST(13787848793156543929 AS UHUGEINT))"))
_MIXED.append(_WRAP.format(f"({_U.format('xor(v, v >> 27)')} * CAST(10723151780598845931 AS UHUGEINT))"))
_MIXED.append("xor(v, v >> 31)")
ORACLE["bounded_family_sample"] = f"""WITH {_ITEMS}, m AS (SELECT item_id, asset_id, user_id % 40 AS family, t_ms, user_id % 40 * 256 + item_id % 256 AS hash FROM items),
    o AS (SELECT item_id, asset_id, family, row_number() OVER (PARTITION BY asset_id, family ORDER BY t_ms, hash) - 1 AS ordinal FROM m), """ + ", ".join(f"v{k} AS (SELECT * {'EXCLUDE (v)' if k else ''}, {x} AS v FROM {f'v{k - 1}' if k else 'o'})" for k, x in enumerate(_MIXED)) + """
    SELECT item_id, asset_id, CAST(family AS BIGINT) AS family, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, family ORDER BY v, ordinal) AS r FROM v4) WHERE r <= 8"""


# Files of several episodes: the events of a type, cut by some of their times, or by durations that nations give.


def _ranged(spark, d):
    timed = items(spark, d).select("asset_id", F.col("t_ms").alias("mapped_ms"))
    ranges = timed.select("asset_id").distinct().select("asset_id", F.lit(None).cast("int").alias("season"), F.lit(1).alias("episode_start"), (2 + F.length("asset_id") % 3).cast("int").alias("episodes"))
    return timed, ranges


@query
def range_parts_cut(spark, d):
    cuts = items(spark, d).filter("item_id % 37 = 0").select("asset_id", F.col("t_ms").alias("cut_ms"))
    return merge.split_ranges(*_ranged(spark, d), cuts=cuts).filter("rule = 'cutPoints'").withColumn("part", F.col("part").cast("long"))


@query
def range_parts_durations(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("place"), F.lit(None).cast("int").alias("season"), (F.col("n_nationkey") + 1).cast("int").alias("episode"), ((F.col("n_nationkey") % 5 + 1) * 3 * L.DAY).cast("long").alias("duration_ms"))
    return merge.split_ranges(*_ranged(spark, d), known=n).withColumn("part", F.col("part").cast("long"))


_RANGED = f"{_ITEMS}, ends AS (SELECT asset_id, min(t_ms) AS a, max(t_ms) AS z, 2 + length(asset_id) % 3 AS e FROM items GROUP BY asset_id)"
ORACLE["range_parts_cut"] = f"""WITH {_RANGED}, c AS (SELECT i.asset_id, t_ms, row_number() OVER (PARTITION BY i.asset_id ORDER BY t_ms) AS r FROM items i JOIN ends USING (asset_id) WHERE item_id % 37 = 0 AND t_ms > a AND t_ms < z),
    k AS (SELECT asset_id, r, t_ms FROM c JOIN ends USING (asset_id) WHERE r < e UNION ALL SELECT asset_id, 0, a FROM ends UNION ALL SELECT asset_id, e, z + 1 FROM ends),
    p AS (SELECT asset_id, r + 1 AS part, t_ms AS start_ms, lead(t_ms) OVER (PARTITION BY asset_id ORDER BY r) AS end_ms FROM k)
    SELECT p.*, 'cutPoints' AS rule FROM p JOIN ends USING (asset_id) WHERE end_ms IS NOT NULL AND (SELECT count(*) FROM c WHERE c.asset_id = p.asset_id AND c.r < ends.e) = e - 1"""
ORACLE["range_parts_durations"] = f"""WITH {_RANGED}, d AS (SELECT asset_id, a, n_nationkey + 1 AS part, (n_nationkey % 5 + 1) * 3 * {L.DAY} AS d FROM ends JOIN nation ON n_nationkey < e)
    SELECT asset_id, CAST(part AS BIGINT) AS part, CAST(a + sum(d) OVER w - d AS BIGINT) AS start_ms, CAST(a + sum(d) OVER w AS BIGINT) AS end_ms, 'durations' AS rule FROM d WINDOW w AS (PARTITION BY asset_id ORDER BY part)"""
