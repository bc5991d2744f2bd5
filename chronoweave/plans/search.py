"""Queries and SQL for the search of recordings: block localisation, banded alignment, the frontier of fine scoring."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import affine, banded, frontier, graph, localise
from .oracle import _ITEMS, ORACLE
from .queries import items, query, table

# Block localisation: a label's vectors are one recording; the target lacks its first frames.
LACKS, BLOCK, STRIDE, APART, FRAME_MS = 6, 8, 5, 16, 500
_BANDS = "list_transform(embedding, lambda x: least(255, greatest(0, CAST(floor(CAST(x AS DOUBLE) * 400 + 128) AS BIGINT))))"


def _recorded(spark, d):
    x = F.transform("embedding", lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(v.cast("double") * 400 + 128))).cast("int"))
    active = F.when(F.col("vec_id") % 11 == 0, 50).otherwise(400 + F.col("vec_id") % 600)
    f = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("pair"), (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long").alias("frame"), x.alias("values"), active.cast("int").alias("active"))
    timed = lambda df: df.withColumn("time_ms", F.col("frame") * FRAME_MS)
    return timed(f), timed(f.filter(F.col("frame") >= LACKS).withColumn("frame", F.col("frame") - LACKS))


def _blocks(spark, d):
    return localise.locate_blocks(*_recorded(spark, d), block=BLOCK, stride=STRIDE)


@query
def located_blocks(spark, d):
    return _blocks(spark, d).select("pair", "request", "start", "place", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"), "source_ms", "target_ms", "held_out")


@query
def block_summary(spark, d):
    s = localise.summary(_blocks(spark, d))
    return s.select("pair", "n_blocks", "n_accepted", "n_training", *[F.round(c, 6).alias(c) for c in ("best_score", "median_score", "best_margin", "median_margin")])


def _bounds(target):
    return target.groupBy("pair").agg(F.min("time_ms").alias("start_ms"), (F.max("time_ms") + FRAME_MS).alias("end_ms"))


@query
def block_hypotheses(spark, d):
    h = localise.hypotheses(_blocks(spark, d), _bounds(_recorded(spark, d)[1]), tolerance=2_000)
    return h.withColumns({c: F.round(c, 6) for c in ("coverage", "score")})


@query
def held_out_blocks(spark, d):
    source, target = _recorded(spark, d)
    blocks = graph.cut(localise.locate_blocks(source, target, block=BLOCK, stride=STRIDE))
    found = localise.hypotheses(blocks, _bounds(target), tolerance=2_000)
    kept = localise.held_out(source, target, blocks, found, block=BLOCK, tolerance=2_000, every_ms=1_500)
    return kept.withColumns({c: F.round(c, 6) for c in ("score", "margin")})


_LOCATED = f"""src AS (SELECT label AS pair, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, {_BANDS} AS v, CASE WHEN vec_id % 11 = 0 THEN 50 ELSE 400 + vec_id % 600 END AS a FROM embeddings),
    tgt AS (SELECT pair, frame - {LACKS} AS frame, v, a FROM src WHERE frame >= {LACKS}),
    lens AS (SELECT pair, count(*) AS n FROM tgt GROUP BY 1 HAVING count(*) >= {BLOCK}), slen AS (SELECT pair, count(*) AS m FROM src GROUP BY 1 HAVING count(*) >= {BLOCK}),
    steps AS (SELECT pair, n, range(0, n - {BLOCK} + 1, {STRIDE}) AS r FROM lens), whole AS (SELECT pair, CASE WHEN r[-1] + {BLOCK} < n THEN list_append(r, n - {BLOCK}) ELSE r END AS r FROM steps),
    starts AS (SELECT pair, CASE WHEN len(r) > 32 THEN list_distinct(list_transform(range(32), lambda i: r[i * (len(r) - 1) // 31 + 1])) ELSE r END AS r FROM whole),
    asked AS (SELECT pair, unnest(list_sort(r)) AS start, unnest(range(len(r))) AS request FROM starts),
    cells AS (SELECT s.pair, s.frame AS x, t.frame AS y, s.a >= 100 AND t.a >= 100 AS counts, 1 - abs(s.a - t.a) / 1000.0 AS alike,
        CAST(s.v AS DOUBLE[]) AS p, CAST(t.v AS DOUBLE[]) AS q, CAST(list_transform(list_zip(s.v, coalesce(s2.v, s.v)), lambda z: z[1] - z[2]) AS DOUBLE[]) AS dp, CAST(list_transform(list_zip(t.v, coalesce(t2.v, t.v)), lambda z: z[1] - z[2]) AS DOUBLE[]) AS dq
        FROM src s JOIN tgt t ON t.pair = s.pair LEFT JOIN src s2 ON s2.pair = s.pair AND s2.frame = s.frame - 1 LEFT JOIN tgt t2 ON t2.pair = t.pair AND t2.frame = t.frame - 1),
    valued AS (SELECT pair, x, y, counts, alike, CASE WHEN list_dot_product(p, p) = 0 OR list_dot_product(q, q) = 0 THEN 0 ELSE greatest(0, least(1, list_dot_product(p, q) / (sqrt(list_dot_product(p, p)) * sqrt(list_dot_product(q, q))))) END AS own,
        CASE WHEN list_dot_product(dp, dp) = 0 OR list_dot_product(dq, dq) = 0 THEN 0 ELSE greatest(0, least(1, (list_dot_product(dp, dq) / (sqrt(list_dot_product(dp, dp)) * sqrt(list_dot_product(dq, dq))) + 1) / 2)) END AS moved FROM cells),
    placed AS (SELECT a.pair, a.request, a.start, v.x - (v.y - a.start) AS place, v.y - a.start AS k, v.* EXCLUDE (pair) FROM asked a JOIN valued v ON v.pair = a.pair AND v.y BETWEEN a.start AND a.start + {BLOCK - 1}),
    chained AS (SELECT *, coalesce(lag(counts) OVER (PARTITION BY pair, request, place ORDER BY k), false) AS after FROM placed JOIN slen USING (pair) WHERE place >= 0 AND place <= m - {BLOCK}),
    scores AS (SELECT pair, request, start, place, CASE WHEN count(*) FILTER (counts) >= {-(-BLOCK // 2)} THEN sum(own * 0.6 + CASE WHEN after THEN moved ELSE own END * 0.3 + alike * 0.1) FILTER (counts) / {BLOCK} ELSE 0 END AS score FROM chained GROUP BY ALL),
    folded AS (SELECT pair, request, start, list_reduce(list(struct_pack(b := place, s := score, p := CAST(NULL AS BIGINT), t := CAST(NULL AS DOUBLE)) ORDER BY place), lambda h, x: CASE
        WHEN x.s > h.s THEN struct_pack(b := x.b, s := x.s, p := CASE WHEN abs(h.b - x.b) > {APART} THEN h.b ELSE h.p END, t := CASE WHEN abs(h.b - x.b) > {APART} THEN h.s ELSE h.t END)
        WHEN abs(h.b - x.b) > {APART} AND (h.t IS NULL OR x.s > h.t) THEN struct_pack(b := h.b, s := h.s, p := x.b, t := x.s) ELSE h END) AS r FROM scores GROUP BY ALL),
    blocks AS (SELECT CAST(pair AS BIGINT) AS pair, request, start, r.b AS place, r.s AS score, greatest(0, r.s - coalesce(r.t, 0)) AS margin, (r.b + {BLOCK // 2}) * {FRAME_MS} AS source_ms, (start + {BLOCK // 2}) * {FRAME_MS} AS target_ms, request % 5 = 2 AS held_out FROM folded)"""
ORACLE["located_blocks"] = f"WITH {_LOCATED} SELECT * REPLACE (round(score, 6) AS score, round(margin, 6) AS margin) FROM blocks"
ORACLE["block_summary"] = f"""WITH {_LOCATED}, u AS (SELECT pair, count(*) AS n_blocks, count(*) FILTER (score >= 0.48) AS n_accepted, count(*) FILTER (score >= 0.48 AND margin >= 0.001 AND NOT held_out) AS n_training, list(score ORDER BY score) AS s, list(margin ORDER BY margin) AS g FROM blocks GROUP BY pair)
    SELECT pair, n_blocks, n_accepted, n_training, round(s[-1], 6) AS best_score, round(s[len(s) // 2 + 1], 6) AS median_score, round(g[-1], 6) AS best_margin, round(g[len(g) // 2 + 1], 6) AS median_margin FROM u"""
_HYPOTHESES = f"""{_LOCATED}, limits AS (SELECT pair, n * {FRAME_MS} AS length FROM lens),
    votes AS (SELECT *, target_ms - source_ms AS o FROM blocks WHERE score >= 0.48 AND margin >= 0.001 AND NOT held_out), seeds AS (SELECT DISTINCT pair, o AS seed FROM votes),
    near AS (SELECT s.seed, v.* FROM seeds s JOIN votes v ON v.pair = s.pair AND abs(v.o - s.seed) <= 2000),
    mid AS (SELECT pair, seed, list(o ORDER BY o) AS l FROM near GROUP BY ALL HAVING count(*) >= 5), kept AS (SELECT n.*, m.l[len(m.l) // 2 + 1] AS off FROM near n JOIN mid m USING (pair, seed) WHERE abs(n.o - m.l[len(m.l) // 2 + 1]) <= 2000),
    sums AS (SELECT pair, seed, off, count(*) AS k, min(source_ms) AS a, max(source_ms) AS z, (max(target_ms) - min(target_ms)) / CAST(any_value(length) AS DOUBLE) AS cov, avg(score) AS mean, list(abs(o - off) ORDER BY abs(o - off)) AS r FROM kept JOIN limits USING (pair) GROUP BY ALL),
    rated AS (SELECT *, r[CAST(ceil((len(r) - 1) * 0.95) AS BIGINT) + 1] AS p95, r[CAST(ceil((len(r) - 1) * 0.5) AS BIGINT) + 1] AS p50, least(1, mean * 0.5 + least(1, cov) * 0.3 + least(1, k / 16.0) * 0.2) AS score FROM sums WHERE k >= 5 AND cov >= 0.35),
    lined AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY k DESC, cov DESC, score DESC, p95, off, seed) AS i FROM rated),
    gone AS (SELECT pair, list_reduce(list_prepend([], list([off] ORDER BY i)), lambda g, x: CASE WHEN len(list_filter(g, lambda y: abs(y - x[1]) <= 2000)) > 0 THEN g ELSE list_concat(g, x) END)[1:3] AS offs FROM lined GROUP BY pair),
    hyp AS (SELECT l.pair, CAST(list_position(g.offs, l.off) AS INTEGER) AS rank, off AS offset_ms, k AS n_training, a AS source_start_ms, z AS source_end_ms, least(1, cov) AS coverage, p50 AS p50_ms, p95 AS p95_ms, r[-1] AS max_ms, score, row_number() OVER (PARTITION BY l.pair, off ORDER BY i) AS once FROM lined l JOIN gone g ON g.pair = l.pair AND list_contains(g.offs, l.off))"""
ORACLE["block_hypotheses"] = f"WITH {_HYPOTHESES} SELECT * EXCLUDE (once) REPLACE (round(coverage, 6) AS coverage, round(score, 6) AS score) FROM hyp WHERE once = 1"


# The best two places apart, over a plain table: each user's events in order.


@query
def best_two_apart(spark, d):
    w = Window.partitionBy("user_id").orderBy("t_ms", "item_id")
    e = items(spark, d).select("user_id", F.row_number().over(w).cast("long").alias("place"), "value")
    return localise.best_two_apart(e, ["user_id"], "place", "value", 3)


ORACLE["best_two_apart"] = f"""WITH {_ITEMS}, e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t_ms, item_id) AS place, value FROM items),
    f AS (SELECT user_id, list_reduce(list(struct_pack(b := place, s := value, p := CAST(NULL AS BIGINT), t := CAST(NULL AS DOUBLE)) ORDER BY place), lambda h, x: CASE
        WHEN x.s > h.s THEN struct_pack(b := x.b, s := x.s, p := CASE WHEN abs(h.b - x.b) > 3 THEN h.b ELSE h.p END, t := CASE WHEN abs(h.b - x.b) > 3 THEN h.s ELSE h.t END)
        WHEN abs(h.b - x.b) > 3 AND (h.t IS NULL OR x.s > h.t) THEN struct_pack(b := h.b, s := h.s, p := x.b, t := x.s) ELSE h END) AS r FROM e WHERE value IS NOT NULL GROUP BY user_id)
    SELECT user_id, r.b AS place, r.s AS score, r.p AS second_place, r.t AS second_score FROM f"""


# Banded alignment: a label's even vectors against its odd ones, 50 ms a frame.
HOP_MS, RADIUS_MS = 50, 600


def _sequences(spark, d):
    f = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("pair"), "vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    timed = lambda k: f.filter(F.col("vec_id") % 2 == k).withColumn("time_ms", (F.row_number().over(Window.partitionBy("pair").orderBy("vec_id")) - 1).cast("long") * HOP_MS).drop("vec_id")
    return timed(0), timed(1)


@query
def edit_dp(spark, d):
    """Spans of the whole alignment."""
    return banded.aligned(*_sequences(spark, d))


@query
def edit_costs(spark, d):
    """Costs of the ways in a narrow band, to both ends and to the best end."""
    source, target = _sequences(spark, d)
    of = lambda mode, semi: banded.aligned(source, target, semi_global=semi, radius_ms=RADIUS_MS).groupBy("pair").agg(F.max("total_cost").alias("total_cost")).withColumn("mode", F.lit(mode))
    return of("global", False).unionByName(of("semiGlobal", True))


_IN, _IN_W = (f"abs(j - 1 - {i}) * {HOP_MS} <= {RADIUS_MS}" for i in ("i", "w.i"))
ORACLE["edit_costs"] = f"""WITH RECURSIVE f AS (SELECT label AS pair, vec_id % 2 AS side, row_number() OVER (PARTITION BY label, vec_id % 2 ORDER BY vec_id) - 1 AS i, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    c AS (SELECT s.pair, s.i, list(CAST(floor(greatest(0, least(2, 1 - list_dot_product(s.v, t.v) / (sqrt(list_dot_product(s.v, s.v)) * sqrt(list_dot_product(t.v, t.v))))) * 1000 + 0.5) AS BIGINT) ORDER BY t.i) AS c FROM f s JOIN f t ON t.pair = s.pair AND s.side = 0 AND t.side = 1 GROUP BY s.pair, s.i),
    sizes AS (SELECT pair, count(*) AS n, any_value(len(c)) AS m FROM c GROUP BY pair),
    w AS (SELECT pair, n, m, mode, 0 AS i, list_transform(range(m + 1), lambda j: CASE WHEN j = 0 OR mode = 'semiGlobal' THEN 0 ELSE 1000000000 END) AS d0, list_transform(range(m + 1), lambda j: 1000000000) AS d1,
            list_transform(range(m + 1), lambda j: CASE WHEN j > 0 AND mode = 'global' THEN 300 + 60 * (j - 1) ELSE 1000000000 END) AS d2 FROM sizes, (SELECT unnest(['global', 'semiGlobal']) AS mode)
        UNION ALL SELECT pair, n, m, mode, i + 1, n0, n1, list_transform(range(m + 1), lambda j: CASE WHEN j > 0 AND {_IN} THEN least(1000000000, list_min(list_transform(range(CAST(greatest(0, i - {RADIUS_MS // HOP_MS}) AS BIGINT), j), lambda k: least(n0[k + 1], n1[k + 1]) + 300 + 60 * (j - 1 - k)))) ELSE 1000000000 END)
        FROM (SELECT w.*, list_transform(range(m + 1), lambda j: CASE WHEN j > 0 AND {_IN_W} THEN least(1000000000, least(d0[j], d1[j], d2[j]) + c.c[j]) ELSE 1000000000 END) AS n0,
                list_transform(range(m + 1), lambda j: CASE WHEN j = 0 THEN 300 + 60 * w.i WHEN {_IN_W} THEN least(1000000000, least(d0[j + 1] + 300, d1[j + 1] + 60, d2[j + 1] + 300)) ELSE 1000000000 END) AS n1
              FROM w JOIN c ON c.pair = w.pair AND c.i = w.i))
    SELECT CAST(pair AS BIGINT) AS pair, mode, nullif(CASE WHEN mode = 'global' THEN least(d0[m + 1], d1[m + 1], d2[m + 1]) ELSE least(list_min(d0), list_min(d1), list_min(d2)) END, 1000000000) AS total_cost FROM w WHERE i = n"""


# The frontier: a customer's orders of one month in three are a case, an order is a pair, its lines are candidates.


def _inventory(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") * 3 + F.month("o_orderdate") % 3).cast("long").alias("case_id"))
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"), F.floor(F.least(F.max("l_extendedprice"), F.lit(100_000.0)) * 10).alias("upper"), F.max("l_discount").alias("off"), F.min("l_partkey").alias("pk"), F.min("l_suppkey").alias("sk"))
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("case_id", F.col("l_orderkey").alias("pair"), F.col("l_linenumber").cast("long").alias("candidate"), "flag", "upper", F.floor(F.col("upper") * (1 - F.col("off"))).alias("fine"), "pk", "sk")
    state = F.when(F.col("flag") == "R", "scored").when(F.col("flag") == "A", "unresolved").when(F.col("candidate") % 2 == 0, "blocked").otherwise("ineligible")
    rows = rows.withColumn("state", state)
    candidates = rows.select(*frontier.ID, "upper", "state", F.when(F.col("state") == "scored", F.col("fine")).alias("score"))
    axis = lambda name, space, start, length: F.struct(F.lit(name).alias("axis"), space.cast("long").alias("space"), start.cast("long").alias("start_ms"), (start + length).cast("long").alias("end_ms"))
    axes = F.array(axis("source", F.col("sk") % 2, F.col("pk") % 20 * 1000, 3000), axis("target", F.col("pk") % 3, F.col("sk") % 30 * 1000, 2500))
    occupancy = rows.select(*frontier.ID, F.when(F.col("pk") % 5 == 0, 1 + F.col("sk") % 2).cast("long").alias("reuse"), F.inline(axes))
    return candidates, occupancy


def _ids(choices, role):
    return choices.filter(F.col("role") == role).groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.col("pair") * 10 + F.col("candidate"))), lambda x: x.cast("string")), " ").alias(role))


@query
def fine_frontier(spark, d):
    candidates, occupancy = _inventory(spark, d)
    cases, choices = frontier.frontier(candidates, occupancy, margin=5_000, batch=2)
    asked = choices.filter("role = 'batch'").groupBy("case_id").agg(F.count("*").alias("n_batch"))
    out = cases.join(_ids(choices, "best"), "case_id", "left").join(_ids(choices, "runnerUp"), "case_id", "left").join(asked, "case_id", "left")
    return out.fillna({"best": "", "n_batch": 0}).withColumn("runnerUp", F.when(F.col("runner_total").isNotNull(), F.coalesce("runnerUp", F.lit("")))).withColumnRenamed("runnerUp", "runner_up")


_INVENTORY = """li AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS flag, CAST(floor(least(max(l_extendedprice), 100000.0) * 10) AS BIGINT) AS upper, max(l_discount) AS off, min(l_partkey) AS pk, min(l_suppkey) AS sk FROM lineitem GROUP BY ALL),
    c AS (SELECT o_custkey * 3 + month(o_orderdate) % 3 AS case_id, l_orderkey AS pair, l_orderkey * 10 + l_linenumber AS id, upper, pk, sk, CAST(floor(upper * (1 - off)) AS BIGINT) AS fine,
            CASE WHEN flag = 'R' THEN 'scored' WHEN flag = 'A' THEN 'unresolved' WHEN l_linenumber % 2 = 0 THEN 'blocked' ELSE 'ineligible' END AS state FROM li JOIN orders ON o_orderkey = l_orderkey),
    ex AS (SELECT a.id, list(b.id) AS others FROM c a JOIN c b ON b.case_id = a.case_id AND b.pair <> a.pair AND a.state = 'scored' AND b.state = 'scored'
        AND (a.sk % 2 = b.sk % 2 AND 3000 - abs(a.pk % 20 - b.pk % 20) * 1000 > 250 OR a.pk % 3 = b.pk % 3 AND 2500 - abs(a.sk % 30 - b.sk % 30) * 1000 > 250) AND NOT (a.pk % 5 = 0 AND b.pk % 5 = 0 AND a.sk % 2 = b.sk % 2) GROUP BY a.id),
    pairs AS (SELECT case_id, pair, row_number() OVER (PARTITION BY case_id ORDER BY pair) AS k FROM (SELECT DISTINCT case_id, pair FROM c WHERE state = 'scored')),
    options AS (SELECT case_id, pair, id, fine, others FROM c LEFT JOIN ex USING (id) WHERE state = 'scored' UNION ALL SELECT case_id, pair, NULL, 0, NULL FROM pairs),
    walk AS (SELECT DISTINCT case_id, 0 AS k, CAST(0 AS BIGINT) AS total, CAST([] AS BIGINT[]) AS chosen FROM c
        UNION ALL SELECT w.case_id, w.k + 1, w.total + o.fine, CASE WHEN o.id IS NULL THEN w.chosen ELSE list_append(w.chosen, o.id) END FROM walk w JOIN pairs p ON p.case_id = w.case_id AND p.k = w.k + 1 JOIN options o ON o.case_id = p.case_id AND o.pair = p.pair WHERE o.others IS NULL OR NOT list_has_any(w.chosen, o.others)),
    ended AS (SELECT w.* FROM walk w LEFT JOIN (SELECT case_id, max(k) AS n FROM pairs GROUP BY 1) USING (case_id) WHERE w.k = coalesce(n, 0)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY total DESC, list_append(chosen, 9223372036854775807)) AS r FROM ended),"""
ORACLE["fine_frontier"] = f"""WITH RECURSIVE {_INVENTORY}
    worths AS (SELECT case_id, pair, id, state, CASE WHEN state = 'scored' THEN fine ELSE upper END AS worth FROM c WHERE state <> 'ineligible'),
    sums AS (SELECT case_id, pair, max(worth) AS b, max(worth) FILTER (state <> 'scored') AS o FROM worths GROUP BY ALL),
    bounds AS (SELECT case_id, sum(b) - min(b - o) AS bound FROM sums GROUP BY 1 HAVING min(b - o) IS NOT NULL),
    heads AS (SELECT s.case_id, s.pair, s.b - s.o AS loss, arg_min(w.id, (-w.worth, w.id)) AS own, arg_min(w.id, (-w.worth, w.id)) FILTER (w.state <> 'scored') AS other FROM sums s JOIN worths w USING (case_id, pair) GROUP BY ALL),
    least_loss AS (SELECT case_id, min(loss) AS low FROM heads GROUP BY 1 HAVING min(loss) IS NOT NULL),
    way AS (SELECT case_id, CASE WHEN bool_or(own = other) THEN NULL ELSE coalesce(min(pair) FILTER (other < own), max(pair)) END AS way FROM heads JOIN least_loss USING (case_id) WHERE loss = low GROUP BY 1),
    hope AS (SELECT h.case_id, count(*) FILTER (c.state = 'unresolved') AS waiting FROM heads h JOIN way w USING (case_id) JOIN c ON c.id = CASE WHEN h.pair IS NOT DISTINCT FROM w.way THEN h.other ELSE h.own END GROUP BY 1),
    base AS (SELECT e.case_id, f.total AS best_total, g.total AS runner_total, CAST(b.bound AS BIGINT) AS bound, f.chosen AS best, g.chosen AS runner_up, e.any_live, coalesce(h.waiting, 0) AS waiting
        FROM (SELECT case_id, bool_or(state <> 'ineligible') AS any_live FROM c GROUP BY 1) e JOIN ranked f ON f.case_id = e.case_id AND f.r = 1 LEFT JOIN ranked g ON g.case_id = e.case_id AND g.r = 2 LEFT JOIN bounds b ON b.case_id = e.case_id LEFT JOIN hope h ON h.case_id = e.case_id),
    stated AS (SELECT *, CASE WHEN NOT any_live THEN 'noEligible' WHEN coalesce(best_total > runner_total + 5000, true) AND coalesce(best_total > bound + 5000, true) AND len(best) > 0 THEN 'resolved' WHEN waiting > 0 THEN 'pending' ELSE 'unresolved' END AS state FROM base)
    SELECT case_id, best_total, runner_total, bound, state, CASE WHEN state IN ('pending', 'unresolved') THEN greatest(0, waiting - 2) ELSE 0 END AS deferred, CASE WHEN state = 'pending' THEN least(2, waiting) ELSE 0 END AS n_batch,
        array_to_string(best, ' ') AS best, CASE WHEN runner_total IS NOT NULL THEN array_to_string(runner_up, ' ') END AS runner_up FROM stated"""


# Affine hypotheses: a user's events are matched landmarks on a line of scale 1.01, every third one elsewhere.


def _observed(spark, d):
    e = items(spark, d).select(F.col("user_id").cast("long").alias("pair"), F.col("item_id").cast("long").alias("i"))
    target = F.when(F.col("i") % 3 != 0, F.floor(F.col("i") * 707 + 5000 + F.col("i") % 50)).otherwise(F.col("i") * 31 % 9973 * 500)
    return e.select("pair", (F.col("i") - F.col("i") % 2).alias("source_id"), F.col("i").alias("target_id"), ((F.col("i") - F.col("i") % 2) * 700).alias("source_ms"), target.cast("long").alias("target_ms"))


def _hypotheses(spark, d):
    o = _observed(spark, d)
    return affine.hypotheses(o, o.groupBy("pair").agg(F.countDistinct("source_id").alias("n_source"), F.countDistinct("target_id").alias("n_target")), within=400)


@query
def affine_seeds(spark, d):
    return affine.seeds(_observed(spark, d)).select("pair", F.col("seed").cast("long").alias("seed"), F.round("scale", 9).alias("scale"), F.round("offset", 3).alias("offset"))


@query
def affine_hypotheses(spark, d):
    h = _hypotheses(spark, d)
    return h.withColumns({c: F.round(c, 6) for c in ("scale", "source_coverage", "target_coverage", "margin")}).withColumns({c: F.col(c).cast("long") for c in ("rank", "seed")}).drop("fitted_offset")


_OBSERVED = """o AS (SELECT CAST(user_id AS BIGINT) AS pair, event_id - event_id % 2 AS sid, event_id AS tid, (event_id - event_id % 2) * 700 AS s, CASE WHEN event_id % 3 <> 0 THEN event_id * 707 + 5000 + event_id % 50 ELSE event_id * 31 % 9973 * 500 END AS t FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY s, t, sid, tid) - 1 AS r, count(*) OVER (PARTITION BY pair) AS n FROM o), q AS (SELECT *, greatest(1, n // 96) AS one, greatest(1, n // 48) AS two FROM r),
    every AS (SELECT pair, r AS i, -1 AS j, CAST(1 AS DOUBLE) AS scale, CAST(t - s AS DOUBLE) AS off FROM q WHERE r % one = 0 AND r // one < 256
        UNION ALL SELECT a.pair, a.r, b.r, (b.t - a.t) / CAST(b.s - a.s AS DOUBLE), a.t - (b.t - a.t) / CAST(b.s - a.s AS DOUBLE) * a.s FROM q a JOIN q b ON b.pair = a.pair AND a.r % a.two = 0 AND b.r > a.r AND (b.r - a.r - 1) % a.two = 0 AND a.sid <> b.sid AND abs(b.s - a.s) >= 500 AND (b.t - a.t) / CAST(b.s - a.s AS DOUBLE) BETWEEN 0.94 AND 1.06),
    m0 AS (SELECT * FROM (SELECT pair, row_number() OVER (PARTITION BY pair ORDER BY j >= 0, i, j) - 1 AS seed, scale, off FROM every) WHERE seed < 768)"""


def _supported(m: str, k: int) -> str:
    return f"""near{k} AS (SELECT m.*, sid, tid, s, t, CAST(floor(abs(t - (scale * s + off)) + 0.5) AS BIGINT) AS res FROM {m} m JOIN o USING (pair) WHERE floor(abs(t - (scale * s + off)) + 0.5) <= 400),
    best{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair, seed, sid ORDER BY res, t, tid) AS c FROM near{k}) WHERE c = 1),
    in{k} AS (SELECT * FROM (SELECT *, max(t) OVER (PARTITION BY pair, seed ORDER BY s, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM best{k}) WHERE reach IS NULL OR t > reach)"""


def _fitted(k: int) -> str:
    return f"m{k + 1} AS (SELECT pair, seed, regr_slope(t, s) AS scale, avg(t) - regr_slope(t, s) * avg(s) AS off FROM in{k} GROUP BY ALL HAVING count(*) >= 4 AND regr_slope(t, s) BETWEEN 0.94 AND 1.06)"


ORACLE["affine_seeds"] = f"WITH {_OBSERVED} SELECT pair, seed, round(scale, 9) AS scale, round(off, 3) AS offset FROM m0"
ORACLE["affine_hypotheses"] = f"""WITH {_OBSERVED}, {_supported("m0", 0)}, {_fitted(0)}, {_supported("m1", 1)}, {_fitted(1)}, {_supported("m2", 2)},
    h AS (SELECT pair, seed, scale, CAST(round(off) AS BIGINT) AS offset_ms, count(*) AS n_inliers, min(s) AS source_start_ms, max(s) AS source_end_ms, list(res ORDER BY res) AS r FROM in2 GROUP BY pair, seed, scale, off HAVING count(*) >= 4),
    g AS (SELECT pair, list_reduce(list_prepend(CAST([] AS DOUBLE[][]), list([[CAST(seed AS DOUBLE), scale, CAST(offset_ms AS DOUBLE)]] ORDER BY seed)), lambda got, x: CASE WHEN len(list_filter(got, lambda y: abs(y[2] - x[1][2]) < 0.0005 AND abs(y[3] - x[1][3]) < 40)) > 0 THEN got ELSE list_concat(got, x) END) AS kept FROM h GROUP BY pair),
    tot AS (SELECT pair, count(DISTINCT sid) AS ns, count(DISTINCT tid) AS nt FROM o GROUP BY pair),
    k AS (SELECT h.*, n_inliers / CAST(ns AS DOUBLE) AS source_coverage, n_inliers / CAST(nt AS DOUBLE) AS target_coverage, r[CAST(ceil((len(r) - 1) * 0.5) AS BIGINT) + 1] AS p50_ms, r[CAST(ceil((len(r) - 1) * 0.95) AS BIGINT) + 1] AS p95_ms, r[-1] AS max_ms
        FROM h JOIN (SELECT pair, CAST(unnest(kept)[1] AS BIGINT) AS seed FROM g) USING (pair, seed) JOIN tot USING (pair)),
    z AS (SELECT *, row_number() OVER w AS rank, lead(n_inliers - p95_ms / 800.0) OVER w AS next FROM k WINDOW w AS (PARTITION BY pair ORDER BY n_inliers DESC, p95_ms, source_coverage DESC, target_coverage DESC, abs(offset_ms), scale, seed))
    SELECT pair, rank, seed, round(scale, 6) AS scale, offset_ms, n_inliers, round(source_coverage, 6) AS source_coverage, round(target_coverage, 6) AS target_coverage, source_start_ms, source_end_ms, p50_ms, p95_ms, max_ms,
        CASE WHEN rank = 1 THEN round(least(1, greatest(0, (greatest(n_inliers - p95_ms / 800.0, 0.001) - coalesce(next, 0)) / greatest(n_inliers - p95_ms / 800.0, 0.001))), 6) END AS margin FROM z"""


@query
def held_out_anchors(spark, d):
    """Every fifth event, against the line that the others lie near and one that none does."""
    o = _observed(spark, d).withColumns({"source_ms": F.col("source_ms") % 90_000, "target_ms": F.col("target_ms") % 90_900})
    lines = o.select("pair").distinct().select("pair", F.explode(F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(a).alias("scale"), F.lit(b).alias("offset_ms")) for k, a, b in ((1, 1.01, 5_000), (2, 0.97, -700))])).alias("m")).select("pair", "m.*")
    return affine.held_out(lines, o.filter("target_id % 5 < 3"), within=900).withColumn("rank", F.col("rank").cast("long"))


ORACLE["held_out_anchors"] = """WITH o AS (SELECT CAST(user_id AS BIGINT) AS pair, event_id - event_id % 2 AS source_id, event_id AS target_id, (event_id - event_id % 2) * 700 % 90000 AS s, CASE WHEN event_id % 3 <> 0 THEN event_id * 707 + 5000 + event_id % 50 ELSE event_id * 31 % 9973 * 500 END % 90900 AS t FROM events WHERE event_id % 5 < 3),
    m AS (SELECT * FROM (VALUES (1, 1.01::DOUBLE, 5000), (2, 0.97::DOUBLE, -700)) v(rank, scale, off)),
    e AS (SELECT o.*, rank, CAST(round(t - (scale * s + off)) AS BIGINT) AS r, s // 5000 AS a, CAST(floor(round(t - (scale * s + off)) / 250) AS BIGINT) AS b FROM o, m),
    c AS (SELECT x.pair, x.rank, x.a, x.b FROM (SELECT DISTINCT pair, rank, a, b FROM e) x JOIN e y ON y.pair = x.pair AND y.rank = x.rank AND y.a BETWEEN x.a - 2 AND x.a + 2 AND y.b BETWEEN x.b - 1 AND x.b + 1
        GROUP BY ALL HAVING count(DISTINCT y.source_id) >= 3 AND count(DISTINCT y.target_id) >= 3 AND count(DISTINCT y.s // 1000) >= 3 AND count(DISTINCT y.t // 1000) >= 3),
    k AS (SELECT e.*, row_number() OVER (PARTITION BY e.pair, e.rank, source_id ORDER BY abs(r), t, s) AS n FROM e LEFT JOIN c ON c.pair = e.pair AND c.rank = e.rank AND c.a = e.a AND c.b = e.b WHERE abs(r) <= 900 OR c.pair IS NOT NULL)
    SELECT pair, CAST(rank AS BIGINT) AS rank, source_id, s AS source_ms, t AS target_ms, abs(r) AS residual_ms FROM k WHERE n = 1"""
