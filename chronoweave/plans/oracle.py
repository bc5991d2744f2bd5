"""DuckDB SQL for the queries, over the same tables."""

from __future__ import annotations

from . import fixtures as L

DAY = L.DAY
_MS = "(epoch_us(ts) // 1000 - epoch_us(TIMESTAMP '2024-01-01') // 1000)"
_ITEMS = f"items AS (SELECT event_id AS item_id, event_type AS asset_id, {_MS} AS t_ms, props AS text, event_id AS original_index, value >= 5 AS enabled, event_id % 6 AS mode, user_id, value FROM events)"
_RESOLVED = f"""{_ITEMS}, {L.CLIPS.cte()}, {L.STEPS.cte()},
    placed AS (SELECT c.clip_id, i.*, c.timeline_start_ms + i.t_ms - c.source_in_ms + c.local_offset_ms + CASE WHEN i.item_id % {L.ADJUST_EVERY} = 0 THEN i.item_id % 7 * 100 - 300 ELSE 0 END + 500 AS raw_ms
               FROM items i JOIN clips c ON i.asset_id = c.asset_id AND c.enabled AND i.t_ms >= c.source_in_ms AND i.t_ms < c.source_out_ms),
    resolved AS (SELECT *, raw_ms + CAST(coalesce((SELECT sum(target_gap_ms) FROM steps WHERE source_at_ms <= raw_ms), 0) AS BIGINT) AS final_ms FROM placed)"""


def _mapped(points: str) -> str:
    """CTEs giving ``mapped`` from ``points`` (point_id, map_id, t_ms)."""
    return f"""
    held AS (SELECT p.*, s.span_index AS si, s.kind, s.source_start_ms AS a, s.source_end_ms AS z, s.target_start_ms AS ta, s.target_end_ms AS tz
             FROM {points} p LEFT JOIN spans s ON s.map_id = p.map_id AND s.source_end_ms > s.source_start_ms AND p.t_ms >= s.source_start_ms AND p.t_ms < s.source_end_ms),
    marked AS (SELECT h.*, (SELECT min(span_index) FROM spans s WHERE s.map_id = h.map_id AND s.kind = 'ambiguous' AND s.source_start_ms = s.source_end_ms AND s.source_start_ms = h.t_ms) AS di,
                      (SELECT min(span_index) FROM spans s WHERE s.map_id = h.map_id AND s.kind = 'targetOnly' AND s.source_start_ms = h.t_ms) AS ei,
                      (SELECT min(source_start_ms) FROM spans s WHERE s.map_id = h.map_id AND s.span_index = 0) AS ms FROM held h),
    mapped AS (SELECT *, CASE WHEN di IS NOT NULL OR kind = 'ambiguous' THEN 'ambiguous' WHEN kind = 'matched' THEN 'mapped' ELSE 'unmapped' END AS status,
                      CASE WHEN di IS NOT NULL OR kind = 'ambiguous' THEN 'ambiguousSpan' WHEN kind = 'matched' THEN NULL WHEN si IS NOT NULL THEN 'sourceOnly' WHEN ei IS NOT NULL THEN 'targetOnlyBoundary'
                           WHEN ms IS NULL THEN 'emptyMap' WHEN t_ms < ms THEN 'beforeMap' ELSE 'afterMap' END AS reason,
                      coalesce(di, si, ei) AS span_index,
                      CASE WHEN di IS NULL AND kind = 'matched' THEN least(tz - 1, ta + CAST((2 * CAST(t_ms - a AS HUGEINT) * (tz - ta) + (z - a)) // (2 * (z - a)) AS BIGINT)) END AS target_ms FROM marked)"""


_BLOCKED = f"""{L.SEGMENTS.cte()}, {L.BINDINGS.cte()}, {L.MEDIA.cte()}, {L.MAPS.cte()}, {L.SPANS.cte()},
    clash AS (SELECT a.segment_id AS l, b.segment_id AS r FROM segments a JOIN segments b ON a.asset_id = b.asset_id AND a.source_id = b.source_id AND a.segment_id <> b.segment_id
              AND a.source_start_ms < b.source_end_ms AND b.source_start_ms < a.source_end_ms AND (a.kind = 'ignored' OR b.kind = 'ignored' OR a.target_id = b.target_id)),
    usable AS (SELECT s.*, CASE WHEN s.segment_id IN (SELECT l FROM clash) THEN 'overlap' WHEN s.source_end_ms <= s.source_start_ms THEN 'emptyRange' WHEN b.source_id IS NULL THEN 'assetNotBound'
                 WHEN b.source_id <> s.source_id THEN 'otherSource' WHEN ms.media_id IS NULL THEN 'unknownSource'
                 WHEN s.kind = 'content' AND mt.role IS NULL THEN 'unknownTarget' WHEN s.kind = 'content' AND mt.role <> 'target' THEN 'notATarget'
                 WHEN s.kind = 'content' AND s.map_id IS NULL THEN 'noTimeMap' WHEN s.kind = 'content' AND m.state IS NULL THEN 'unknownTimeMap' WHEN s.kind = 'content' AND m.state <> 'confirmed' THEN 'timeMapNotConfirmed'
                 WHEN s.kind = 'content' AND (m.source_id <> s.source_id OR m.target_id <> s.target_id) THEN 'timeMapOfOtherMedia' END AS blocker
               FROM segments s LEFT JOIN bindings b ON b.asset_id = s.asset_id LEFT JOIN media ms ON ms.media_id = s.source_id LEFT JOIN media mt ON mt.media_id = s.target_id LEFT JOIN maps m ON m.map_id = s.map_id)"""
_PROJECTED = f"""{_ITEMS}, {_BLOCKED},
    hits AS (SELECT i.*, u.segment_id, u.target_id, u.map_id FROM items i JOIN usable u ON u.asset_id = i.asset_id AND u.kind = 'content' AND u.blocker IS NULL AND i.t_ms >= u.source_start_ms AND i.t_ms < u.source_end_ms),
    {_mapped("hits")}"""
_ORDERS = "spans0 AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS line_id, CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS start_day, greatest(CAST(l_shipdate AS DATE) - DATE '1970-01-01', CAST(o_orderdate AS DATE) - DATE '1970-01-01' + 1) AS end_day FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_SHORT = f"short AS (SELECT user_id, event_id, {_MS} AS s, {_MS} + (event_id % 7 + 1) * 1200000 AS e FROM events)"
_OFFSETS = f"{_ITEMS}, offs AS (SELECT user_id, item_id, t_ms, t_ms // {2 * DAY} * 4000 + CASE WHEN item_id % 9 = 0 THEN 8000 ELSE 0 END AS offset_ms, value / 1000 AS distance FROM items)"
_SEGS = f"""{_OFFSETS}, marks AS (SELECT *, CASE WHEN lag(offset_ms) OVER w = offset_ms THEN 0 ELSE 1 END AS fresh FROM offs WINDOW w AS (PARTITION BY user_id ORDER BY t_ms, item_id)),
    runs AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t_ms, item_id ROWS UNBOUNDED PRECEDING) AS run FROM marks),
    segs AS (SELECT user_id, CAST(run AS BIGINT) AS run, min(t_ms) AS start_ms, max(t_ms) AS end_ms, min(offset_ms) AS offset_ms, count(*) AS n_rows, avg(distance) AS mean_distance FROM runs GROUP BY user_id, run)"""
_FRAMES = "frames AS (SELECT vec_id, vec_id * 500 AS t, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
_FP = f"""{_FRAMES}, keyed AS (SELECT *, floor(v[1] * 4 + 0.5) AS k1, floor(v[2] * 4 + 0.5) AS k2 FROM frames),
    tgt AS (SELECT *, row_number() OVER (PARTITION BY k1, k2 ORDER BY t, vec_id) - 1 AS i, count(*) OVER (PARTITION BY k1, k2) AS n FROM keyed WHERE vec_id % 2 = 1),
    few AS (SELECT * FROM tgt WHERE n <= 32 OR i IN (SELECT s * n // 32 FROM range(32) r(s))),
    pairs AS (SELECT * FROM (SELECT a.vec_id AS source_id, b.vec_id AS target_id, a.t AS source_t, b.t AS target_t, sqrt(list_sum(list_transform(range(1, 65), lambda j: (a.v[j] - b.v[j]) * (a.v[j] - b.v[j]))) / 64) AS distance
              FROM keyed a JOIN few b ON a.k1 = b.k1 AND a.k2 = b.k2 WHERE a.vec_id % 2 = 0) WHERE distance <= 0.2)"""
_LABELLED = "lab AS (SELECT l.*, d.n_chars, d.lang, d.n_chars / (d.n_chars + 1000) AS p, CASE WHEN l.quality = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM labels l JOIN documents d USING (doc_id))"
_BINS = f"{_LABELLED}, bins AS (SELECT least(CAST(floor(p * 10) AS BIGINT), 9) AS bin, count(*) AS n, avg(p) AS confidence, avg(y) AS accuracy, abs(avg(p) - avg(y)) AS gap FROM lab GROUP BY 1)"


def _code(ms: str) -> str:
    t = f"greatest(0, {ms})"
    return f"printf('%02d:%02d:%02d.%03d', {t} // 3600000, {t} // 60000 % 60, {t} // 1000 % 60, {t} % 1000)"


def _clusters(rules: list[tuple[str, str, int]], window: int, least: int = 2) -> str:
    test = [f"regexp_matches(text, '{p}')" for _, p, _ in rules]
    score = " + ".join(f"CASE WHEN {t} THEN {w} ELSE 0 END" for t, (_, _, w) in zip(test, rules))
    labels = ", ".join(f"CASE WHEN {t} THEN '{n}' END" for t, (n, _, _) in zip(test, rules))
    return f"""docs AS (SELECT source AS asset_id, doc_id * 1000 AS t_ms, doc_id AS id, replace(text, chr(10), ' ') AS text0, text FROM documents),
    hits AS (SELECT asset_id, t_ms, id, {score} AS s, list_filter([{labels}], lambda x: x IS NOT NULL) AS k FROM docs WHERE {" OR ".join(test)}),
    found AS (SELECT asset_id, t_ms // {window} AS bucket, list_sort(list(t_ms)) AS ts, count(*) AS hit_count, CAST(sum(s) AS BIGINT) AS score, list(id ORDER BY t_ms, id) AS ids, flatten(list(k ORDER BY t_ms, id)) AS ks FROM hits GROUP BY 1, 2 HAVING count(*) >= {least})"""


ORACLE = {
    "resolve_events": f"WITH {_RESOLVED} SELECT clip_id, item_id, original_index, enabled, raw_ms, final_ms FROM resolved",
    "density_buckets": f"""WITH {_ITEMS}, n AS (SELECT t_ms // 3600000 * 3600000 AS b, count(*) AS n FROM items WHERE enabled AND t_ms BETWEEN 0 AND {30 * DAY + 1} GROUP BY 1)
        SELECT r * 3600000 AS bucket_ms, (r + 1) * 3600000 AS end_ms, coalesce(n, 0) AS n_events FROM range({-(-(30 * DAY + 1) // 3_600_000)}) t(r) LEFT JOIN n ON b = r * 3600000""",
    "resolved_density": f"""WITH {_RESOLVED}, n AS (SELECT final_ms // {DAY // 4} * {DAY // 4} AS b, count(*) AS n FROM resolved WHERE enabled AND final_ms BETWEEN {DAY} AND {60 * DAY} GROUP BY 1)
        SELECT {DAY} + r * {DAY // 4} AS bucket_ms, {DAY} + (r + 1) * {DAY // 4} AS end_ms, coalesce(n, 0) AS n_events FROM range({59 * 4}) t(r) LEFT JOIN n ON b = {DAY} + r * {DAY // 4}""",
    "events_in_range": f"WITH {_ITEMS} SELECT item_id, asset_id, t_ms FROM items WHERE t_ms BETWEEN {5 * DAY} AND {9 * DAY}",
    "preview_top80": f"WITH {_ITEMS}, f AS (SELECT item_id, t_ms // 1000 AS final_ms, mode, enabled, original_index FROM items) SELECT item_id, final_ms, mode FROM f WHERE enabled AND final_ms <= 500000 AND final_ms + CASE WHEN mode IN (4, 5) THEN 4500 ELSE 8000 END >= 500000 ORDER BY final_ms, original_index LIMIT 80",
    "asset_time_ranges": f"WITH {_ITEMS} SELECT asset_id, min(t_ms) AS first_ms, greatest(max(t_ms), 0) AS last_ms, count(*) AS n_items FROM items GROUP BY 1",
    "project_duration": f"WITH {_RESOLVED}, {L.MEDIA.cte()} SELECT greatest(60000, (SELECT max(timeline_start_ms + source_out_ms - source_in_ms) FROM clips), (SELECT max(final_ms) FROM resolved), (SELECT max(duration_ms) FROM media)) AS duration_ms",
    "timemap_project": f"WITH {_ITEMS}, {L.SPANS.cte()}, pts AS (SELECT item_id AS point_id, asset_id AS map_id, t_ms FROM items), {_mapped('pts')} SELECT point_id, map_id, t_ms, status, reason, coalesce(span_index, -1) AS span_index, coalesce(target_ms, -1) AS target_ms FROM mapped",
    "timemap_boundaries": f"""WITH {L.SPANS.cte()}, e AS (SELECT DISTINCT map_id, t_ms FROM (SELECT map_id, unnest([source_start_ms, source_end_ms - 1, source_end_ms]) AS t_ms FROM spans) WHERE t_ms >= 0),
        pts AS (SELECT map_id, t_ms, concat_ws(':', map_id, t_ms) AS point_id FROM e), {_mapped("pts")} SELECT point_id, map_id, t_ms, status, reason, coalesce(span_index, -1) AS span_index, coalesce(target_ms, -1) AS target_ms FROM mapped""",
    "timemap_validate": f"""WITH {L.BAD_SPANS.cte()}, g AS (SELECT *, source_end_ms - source_start_ms AS s, target_end_ms - target_start_ms AS t, lag(source_end_ms) OVER w AS ps, lag(target_end_ms) OVER w AS pt FROM bad_spans WINDOW w AS (PARTITION BY map_id ORDER BY span_index))
        SELECT map_id, span_index, code FROM (SELECT map_id, span_index, unnest([
            CASE WHEN s < 0 OR t < 0 OR source_start_ms < 0 OR target_start_ms < 0 THEN 'invalidRange' END, CASE WHEN kind = 'matched' AND (s <= 0 OR t <= 0) THEN 'emptyMatched' END,
            CASE WHEN kind = 'sourceOnly' AND (s <= 0 OR t <> 0) THEN 'badSourceOnly' END, CASE WHEN kind = 'targetOnly' AND (t <= 0 OR s <> 0) THEN 'badTargetOnly' END,
            CASE WHEN kind = 'ambiguous' AND s = 0 AND t = 0 THEN 'emptyAmbiguous' END, CASE WHEN source_start_ms < ps THEN 'sourceOverlap' END, CASE WHEN source_start_ms > ps THEN 'sourceGap' END,
            CASE WHEN target_start_ms < pt THEN 'targetOverlap' END, CASE WHEN target_start_ms > pt THEN 'targetGap' END]) AS code FROM g) WHERE code IS NOT NULL""",
    "legacy_rules_to_spans": f"""WITH {L.RANGES.cte()}, {L.RULES.cte()},
        sums AS (SELECT r.map_id, source_at_ms, CAST(sum(gap_ms) AS BIGINT) AS g FROM rules r JOIN ranges USING (map_id) WHERE source_at_ms >= source_start_ms AND source_at_ms < source_end_ms GROUP BY 1, 2 HAVING sum(gap_ms) <> 0),
        bad AS (SELECT map_id, min(source_at_ms) AS b FROM sums WHERE g < 0 GROUP BY 1),
        knots AS (SELECT s.map_id, s.source_at_ms AS k, greatest(g, 0) AS g, g < 0 AS isbad FROM sums s LEFT JOIN bad USING (map_id) WHERE b IS NULL OR s.source_at_ms <= b
                  UNION ALL SELECT map_id, source_start_ms, 0, FALSE FROM ranges),
        pts AS (SELECT map_id, k, CAST(sum(g) AS BIGINT) AS g, bool_or(isbad) AS isbad FROM knots GROUP BY 1, 2),
        cells AS (SELECT p.*, r.source_end_ms AS e, r.target_start_ms + k - r.source_start_ms + CAST(coalesce(sum(g) OVER (PARTITION BY map_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a, coalesce(lead(k) OVER (PARTITION BY map_id ORDER BY k), r.source_end_ms) AS stop FROM pts p JOIN ranges r USING (map_id)),
        made AS (SELECT map_id, 'targetOnly' AS kind, k AS source_start_ms, k AS source_end_ms, a AS target_start_ms, a + g AS target_end_ms FROM cells WHERE g > 0 AND NOT isbad
                 UNION ALL SELECT map_id, 'ambiguous', k, e, a, a FROM cells WHERE isbad
                 UNION ALL SELECT map_id, 'matched', k, stop, a + g, a + g + stop - k FROM cells WHERE NOT isbad AND stop > k)
        SELECT *, CAST(row_number() OVER (PARTITION BY map_id ORDER BY source_start_ms, target_start_ms, source_end_ms) - 1 AS INTEGER) AS span_index FROM made""",
    "segment_blockers": f"WITH {_BLOCKED} SELECT segment_id, blocker FROM usable",
    "projection_items": f"WITH {_PROJECTED} SELECT item_id, segment_id, target_id, status, reason, coalesce(target_ms, -1) AS final_ms FROM mapped",
    "projection_counts": f"""WITH {_PROJECTED}, b AS (SELECT item_id, bool_or(status = 'mapped') AS m, bool_or(status = 'unmapped') AS u, sum(CASE WHEN status = 'mapped' AND enabled THEN 1 ELSE 0 END) AS en, sum(CASE WHEN status = 'mapped' AND NOT enabled THEN 1 ELSE 0 END) AS off FROM mapped GROUP BY 1),
        ign AS (SELECT DISTINCT i.item_id FROM items i JOIN usable u ON u.asset_id = i.asset_id AND u.kind = 'ignored' AND u.blocker IS NULL AND i.t_ms >= u.source_start_ms AND i.t_ms < u.source_end_ms),
        j AS (SELECT i.item_id, coalesce(m, FALSE) AS m, coalesce(u, FALSE) AS u, en, off, ign.item_id IS NOT NULL AS g FROM items i LEFT JOIN b USING (item_id) LEFT JOIN ign USING (item_id))
        SELECT count(*) AS n_items, CAST(coalesce(sum(en), 0) AS BIGINT) AS projected, CAST(coalesce(sum(off), 0) AS BIGINT) AS disabled, count(*) FILTER (m) AS mapped_items, count(*) FILTER (NOT m AND u) AS source_only, count(*) FILTER (g) AS ignored, count(*) FILTER (NOT m AND NOT u AND NOT g) AS unexpected_unmapped FROM j""",
    "projection_groups": f"""WITH {_PROJECTED} SELECT p.target_id, count(*) FILTER (status = 'mapped' AND enabled) AS n_entries, coalesce(min(target_ms) FILTER (status = 'mapped' AND enabled), -1) AS first_ms, coalesce(max(target_ms) FILTER (status = 'mapped' AND enabled), -1) AS last_ms,
        count(*) FILTER (status = 'mapped' AND NOT enabled) AS n_disabled, count(*) FILTER (status = 'mapped' AND enabled AND target_ms < 0) AS n_negative, count(*) FILTER (status = 'mapped' AND enabled AND target_ms >= m.duration_ms) AS n_overflow FROM mapped p LEFT JOIN media m ON m.media_id = p.target_id GROUP BY 1""",
    "segment_overlaps": f"WITH {_SHORT} SELECT a.user_id, a.event_id AS left_id, b.event_id AS right_id, least(a.e, b.e) - b.s AS overlap FROM short a JOIN short b ON a.user_id = b.user_id AND (a.s < b.s OR a.s = b.s AND a.event_id < b.event_id) AND b.s < a.e",
    "interval_union": f"""WITH {_ORDERS}, w AS (SELECT l_suppkey, start_day, end_day, max(end_day) OVER (PARTITION BY l_suppkey ORDER BY start_day, end_day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM (SELECT DISTINCT l_suppkey, start_day, end_day FROM spans0))
        SELECT l_suppkey, CAST(sum(greatest(0, end_day - greatest(start_day, coalesce(r, start_day)))) AS BIGINT) AS covered FROM w GROUP BY 1""",
    "merged_ranges": f"""WITH {_SHORT}, w AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM short),
        i AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM w) SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS n_spans FROM i GROUP BY user_id, g""",
    "text_hint_clusters": f"""WITH {_clusters([("and", "(?i) and .* the ", 3), ("la", "(?i) de la ", 2), ("der", "(?i) der ", 2)], 100_000)}
        SELECT asset_id, bucket, ts[hit_count // 2 + 1] AS source_at_ms, ts[1] AS start_ms, ts[-1] AS end_ms, hit_count, score, CASE WHEN hit_count >= 5 OR score >= 12 THEN 'high' WHEN hit_count >= 3 OR score >= 7 THEN 'medium' ELSE 'low' END AS confidence,
               array_to_string(list_filter(ks, lambda x, i: list_position(ks, x) = i), ',') AS keywords, array_to_string(ids, ',') AS item_ids FROM found""",
    "text_hint_top12": f"""WITH {_clusters([("the", "(?i)the", 2), ("und", "(?i)und", 2), ("para", "(?i)para", 2)], 100_000)}
        SELECT asset_id, bucket, ts[hit_count // 2 + 1] AS source_at_ms, score, hit_count FROM found ORDER BY score DESC, source_at_ms, asset_id, bucket LIMIT 12""",
    "band_semi_join": f"WITH {_ITEMS} SELECT item_id, t_ms FROM items a WHERE asset_id = 'error' AND EXISTS (SELECT 1 FROM items b WHERE b.asset_id = 'purchase' AND b.t_ms BETWEEN a.t_ms - 300000 AND a.t_ms + 300000)",
    "band_boost": f"""WITH {_ITEMS}, c AS (SELECT item_id, t_ms, round(value / 500, 4) AS confidence, EXISTS (SELECT 1 FROM items b WHERE b.asset_id = 'view' AND b.t_ms BETWEEN a.t_ms - 45000 AND a.t_ms + 45000) AS supported FROM items a WHERE asset_id = 'click')
        SELECT item_id, t_ms, CASE WHEN supported THEN least(0.98::DOUBLE, confidence + 0.03::DOUBLE) ELSE confidence END AS confidence, supported FROM c""",
    "nearest_frame": f"""WITH {_ITEMS}, j AS (SELECT a.item_id, b.item_id AS frame_id, abs(a.t_ms - b.t_ms) AS distance, row_number() OVER (PARTITION BY a.item_id ORDER BY abs(a.t_ms - b.t_ms), b.t_ms, b.item_id) AS r
        FROM items a JOIN items b ON a.asset_id = 'click' AND b.asset_id = 'view' AND b.t_ms BETWEEN a.t_ms - 600000 AND a.t_ms + 600000) SELECT item_id, frame_id, distance FROM j WHERE r = 1""",
    "gap_boundaries": f"""WITH {_ITEMS}, g AS (SELECT user_id, t_ms AS l, lead(t_ms) OVER (PARTITION BY user_id ORDER BY t_ms) AS r FROM items),
        s AS (SELECT user_id, b.b AS boundary_ms, l, r, r - l - abs((l + r) / 2 - b.b) * 0.2::DOUBLE AS score FROM g CROSS JOIN (VALUES ({10 * DAY}), ({20 * DAY})) b(b) WHERE r - l >= 60000 AND abs((l + r) / 2 - b.b) <= {int(0.35 * 10 * DAY)}),
        k AS (SELECT *, row_number() OVER (PARTITION BY user_id, boundary_ms ORDER BY score DESC, l) AS n FROM s) SELECT user_id, CAST(boundary_ms AS BIGINT) AS boundary_ms, l AS left_ms, r AS right_ms, score FROM k WHERE n = 1""",
    "append_segments": "SELECT o_custkey, o_orderkey, CAST(coalesce(sum(CASE WHEN o_orderkey % 5 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) ELSE o_orderkey % 1000 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_ms FROM orders",
    "arrange_clips": "SELECT o_custkey, o_orderkey, CAST(coalesce(sum(greatest(CAST(floor(o_totalprice) AS BIGINT), 100000)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS timeline_start_ms FROM orders",
    "split_clips": f"""WITH {L.CLIPS.cte()}, c AS (SELECT *, source_in_ms + {12 * DAY} - timeline_start_ms AS cut FROM clips), i AS (SELECT *, cut > source_in_ms AND cut < source_out_ms AS inside FROM c)
        SELECT clip_id, 0 AS part, timeline_start_ms, source_in_ms, CASE WHEN inside THEN cut ELSE source_out_ms END AS source_out_ms FROM i UNION ALL SELECT clip_id, 1, {12 * DAY}, cut, source_out_ms FROM i WHERE inside""",
    "window_suffix": f"WITH {_ITEMS} SELECT item_id, t_ms - {20 * DAY} AS window_ms FROM items WHERE t_ms >= {20 * DAY} AND t_ms < {22 * DAY}",
    "anchor_gap_lag": """WITH g AS (SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice / 10) AS BIGINT) AS gap_ms FROM orders), s AS (SELECT *, gap_ms - lag(gap_ms) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS step_ms FROM g) SELECT * FROM s WHERE step_ms >= 1000""",
    "offset_segments": f"WITH {_SEGS} SELECT user_id, run, start_ms, end_ms, offset_ms, n_rows, round(mean_distance, 10) AS mean_distance FROM segs",
    "change_points": f"""WITH {_SEGS}, d AS (SELECT *, offset_ms - lag(offset_ms) OVER w AS gap_ms, lag(end_ms) OVER w AS b FROM segs WINDOW w AS (PARTITION BY user_id ORDER BY run))
        SELECT user_id, CAST(floor((b + start_ms) / 2 + 0.5) AS BIGINT) AS at_ms, gap_ms, n_rows AS support FROM d WHERE gap_ms >= 3000 AND greatest(1000, end_ms - start_ms + 1000) >= 10000""",
    "moving_median5": f"WITH {_ITEMS}, w AS (SELECT item_id, list_sort(list(value) OVER (PARTITION BY user_id ORDER BY t_ms, item_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS s FROM items) SELECT item_id, s[len(s) // 2 + 1] AS median FROM w",
    "increasing_inliers": """WITH b AS (SELECT l_suppkey, CAST(l_linenumber AS BIGINT) AS source_k, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_extendedprice, l_partkey) AS r FROM lineitem),
        m AS (SELECT *, max(l_partkey) OVER (PARTITION BY l_suppkey ORDER BY source_k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b WHERE r = 1) SELECT l_suppkey, source_k, l_partkey, l_extendedprice FROM m WHERE reach IS NULL OR l_partkey > reach""",
    "error_distribution": "SELECT l_returnflag, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.95) AS p95, quantile_disc(l_extendedprice, 0.99) AS p99, max(l_extendedprice) AS max_value, count(l_extendedprice) AS n FROM lineitem GROUP BY 1",
    "percentile_ceil_n1": "SELECT l_returnflag, list_sort(list(l_quantity))[CAST(ceil((count(*) - 1) * 0.95::DOUBLE) AS BIGINT) + 1] AS q95 FROM lineitem GROUP BY 1",
    "prf_metrics": f"""WITH {_LABELLED}, c AS (SELECT lang, count(*) FILTER (quality = 1 AND n_chars > 1000) AS tp, count(*) FILTER (quality <> 1 AND n_chars > 1000) AS fp, count(*) FILTER (quality = 1 AND n_chars <= 1000) AS fn FROM lab GROUP BY 1),
        r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fn) END AS q FROM c)
        SELECT lang, tp, fp, fn, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q = 0 THEN 0.0::DOUBLE ELSE 2 * p * q / (p + q) END, 6) AS f1 FROM r""",
    "ece_bins": f"WITH {_BINS} SELECT bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy, round(gap, 6) AS gap FROM bins",
    "ece_total": f"WITH {_BINS} SELECT round((SELECT sum(n * gap) / sum(n) FROM bins), 6) AS ece, round((SELECT avg((p - y) * (p - y)) FROM lab), 6) AS brier",
    "topk_accuracy": """WITH r AS (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_returnflag) AS r FROM lineitem), f AS (SELECT l_orderkey, min(r) FILTER (l_returnflag = 'R') AS f FROM r GROUP BY 1)
        SELECT count(*) AS n, round(avg(CASE WHEN f <= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS top1, round(avg(CASE WHEN f <= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS top3, round(avg(CASE WHEN f <= 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS top10 FROM f""",
    "affine_fit": "SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, count(*) AS n FROM lineitem GROUP BY 1",
    "weighted_score": """WITH o AS (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS m FROM orders GROUP BY 1),
        s AS (SELECT c_custkey, c_acctbal, CASE WHEN coalesce(n, 0) <= 0 THEN 0.0::DOUBLE WHEN n <= 5 THEN 0.4::DOUBLE WHEN n <= 10 THEN 0.7::DOUBLE WHEN n <= 20 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS a,
                     CASE WHEN m IS NULL THEN NULL WHEN m <= 100000 THEN 0.2::DOUBLE WHEN m <= 200000 THEN 0.5::DOUBLE WHEN m <= 300000 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS b, CASE WHEN c_acctbal >= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c FROM customer LEFT JOIN o ON o_custkey = c_custkey),
        t AS (SELECT *, (a * 20 + coalesce(b * 15, 0) + c * 10) / (30 + CASE WHEN b IS NULL THEN 0 ELSE 15 END) AS score FROM s)
        SELECT c_custkey, round(score, 6) AS score, CASE WHEN c_acctbal < -900 THEN 'blocked' WHEN score >= 0.8::DOUBLE THEN 'recommended' WHEN score >= 0.6::DOUBLE THEN 'review' ELSE 'weak' END AS conclusion FROM t""",
    "fingerprint_join": f"WITH {_FP} SELECT source_id, target_id, source_t, target_t, round(distance, 6) AS distance FROM pairs",
    "offset_votes": f"""WITH {_FP}, c AS (SELECT CAST(floor((target_t - source_t) / 10000 + 0.5) AS BIGINT) * 10000 AS offset_ms, count(*) AS votes FROM pairs GROUP BY 1),
        r AS (SELECT *, row_number() OVER (ORDER BY votes DESC, offset_ms) AS rank FROM c) SELECT * FROM r WHERE rank <= 24 AND (votes >= 2 OR rank <= 8)""",
    "landmark_join_users": f"""WITH {_ITEMS}, m AS (SELECT asset_id, t_ms, CAST(user_id AS BIGINT) AS family, item_id % 256 AS b FROM items),
        s AS (SELECT *, count(*) OVER (PARTITION BY family) AS n FROM m WHERE asset_id = 'click'), t AS (SELECT *, count(*) OVER (PARTITION BY family) AS n FROM m WHERE asset_id = 'view')
        SELECT s.family, s.t_ms AS source_ms, t.t_ms AS target_ms, t.t_ms - s.t_ms AS offset_ms FROM s JOIN t ON s.family = t.family AND abs(s.b - t.b) <= 1 WHERE s.n <= 64 AND t.n <= 64""",
    "landmark_hash": f"WITH {_ITEMS} SELECT item_id, user_id % 256 * 65536 + item_id % 300 % 256 * 256 + least(255, (t_ms % 19000 + 25) // 50) AS h FROM items",
    "spectral_peaks": f"""WITH {_FRAMES}, c AS (SELECT label, vec_id AS frame, unnest(range(0, 64)) AS band, abs(unnest(v)) AS x FROM frames),
        g AS (SELECT *, lag(x) OVER a AS a1, lead(x) OVER a AS a2, lag(x) OVER b AS b1, lead(x) OVER b AS b2, avg(x) OVER (PARTITION BY label, frame) AS m FROM c WINDOW a AS (PARTITION BY label, band ORDER BY frame), b AS (PARTITION BY label, frame ORDER BY band)),
        p AS (SELECT * FROM g WHERE x >= 2.25::DOUBLE * m AND (a1 IS NULL OR x > a1) AND (a2 IS NULL OR x > a2) AND (b1 IS NULL OR x > b1) AND (b2 IS NULL OR x > b2)),
        r AS (SELECT frame, band, row_number() OVER (PARTITION BY label, frame ORDER BY x DESC, band) AS rank FROM p) SELECT * FROM r WHERE rank <= 4""",
    "energy_centroids": f"WITH {_ITEMS} SELECT asset_id, t_ms // 3600000 AS frame, count(*) AS activity, round(sum(ln(1 + value) * user_id) / sum(ln(1 + value)), 4) AS centroid, round(sum(ln(1 + value)), 4) AS energy FROM items GROUP BY 1, 2",
    "rms_distance": f"WITH {_FRAMES} SELECT a.vec_id, round(sqrt(list_sum(list_transform(range(1, 65), lambda j: (a.v[j] - b.v[j]) * (a.v[j] - b.v[j]))) / 64), 6) AS distance FROM frames a, frames b WHERE b.vec_id = 0",
    "cosine_cost": f"WITH {_FRAMES} SELECT a.vec_id, CAST(floor(least(2.0::DOUBLE, greatest(0.0::DOUBLE, 1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))))) * 1000 + 0.5::DOUBLE) AS BIGINT) AS cost FROM frames a, frames b WHERE b.vec_id = 0",
    "duplicate_ids": "SELECT l_orderkey, l_linenumber, count(*) AS n, min(l_returnflag) AS first_label, max(l_returnflag) AS last_label FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "orphans_anti": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)",
    "has_child_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    "health_checks": """SELECT 'duplicateLines' AS "check", count(*) AS n_found FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'orphanOrders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
        UNION ALL SELECT 'orphanLines', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'emptyOrders', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
    "distinct_first": f"WITH {_ITEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, asset_id ORDER BY t_ms, item_id) AS r FROM items) SELECT user_id, asset_id, t_ms, item_id FROM r WHERE r = 1",
    "upsert_rows": "WITH n AS (SELECT s_suppkey * 2 AS s_suppkey, 0.0::DOUBLE AS s_acctbal FROM supplier WHERE s_suppkey % 3 = 0) SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM n) UNION ALL SELECT * FROM n",
    "compare_annotations": """WITH a AS (SELECT p_partkey, p_retailprice AS a FROM part WHERE p_partkey % 10 <> 0), b AS (SELECT p_partkey, p_retailprice + p_partkey % 5 AS b FROM part WHERE p_partkey % 7 <> 0),
        j AS (SELECT p_partkey, CASE WHEN b IS NULL THEN 'missingRight' WHEN a IS NULL THEN 'missingLeft' WHEN abs(a - b) > 3 THEN 'differs' ELSE 'equal' END AS status FROM a FULL JOIN b USING (p_partkey)) SELECT * FROM j WHERE status <> 'equal'""",
    "source_summary": f"WITH {_ITEMS} SELECT asset_id, count(*) AS n_items, count(*) FILTER (enabled) AS n_enabled, count(DISTINCT t_ms // 60000) AS n_minutes, min(t_ms) AS first_ms, max(t_ms) AS last_ms FROM items GROUP BY 1",
    "export_summary": f"WITH {_RESOLVED} SELECT clip_id, count(*) AS n, count(*) FILTER (enabled) AS n_enabled, min(greatest(final_ms, 0)) AS first_ms, max(greatest(final_ms, 0)) AS last_ms, CAST(sum(final_ms - raw_ms) AS BIGINT) AS gap_ms, count(*) FILTER (final_ms < 0) AS n_negative FROM resolved GROUP BY 1",
    "timecodes": f"WITH {_ITEMS} SELECT item_id, {_code('t_ms')} AS code, printf('%d.%03d', greatest(0, t_ms - {DAY}) // 1000, greatest(0, t_ms - {DAY}) % 1000) AS seconds FROM items",
    "rounding": f"WITH {L.NUMBERS.cte()} SELECT x, CAST(floor(x + 0.5) AS BIGINT) AS nearest, CAST(greatest(0, floor(x + 0.5)) AS BIGINT) AS clamped FROM numbers",
    "window_density": f"WITH {_ITEMS} SELECT asset_id AS event_type, t_ms // 21600000 * 21600000 AS start_ms, count(*) AS n_events FROM items GROUP BY 1, 2",
    "frame_groups": "WITH g AS (SELECT label, vec_id // 4 AS \"group\", min(vec_id * 500) AS f, count(*) AS n_frames FROM embeddings GROUP BY 1, 2) SELECT label, \"group\", n_frames, f + CAST(floor((n_frames - 1) * 130 / 2) AS BIGINT) AS time_ms FROM g",
    "presentation_gaps": f"WITH {_ITEMS}, g AS (SELECT CAST(user_id % 4 AS INTEGER) AS stream, t_ms, t_ms - lag(t_ms) OVER (PARTITION BY user_id % 4 ORDER BY t_ms) AS gap FROM items) SELECT stream, min(t_ms) AS first_ms, max(t_ms) AS last_ms, count(*) AS n_frames, max(gap) AS longest_gap_ms, count(*) FILTER (gap > 1800000) AS n_jumps FROM g GROUP BY 1",
    "playback_status": f"""WITH {_ITEMS}, e AS (SELECT DISTINCT user_id, t_ms // 1000000 AS media_ms, CAST(trunc(t_ms / 100) AS BIGINT) AS wall_ms FROM items),
        d AS (SELECT *, wall_ms - lag(wall_ms) OVER w AS wg, media_ms - lag(media_ms) OVER w AS mg FROM e WINDOW w AS (PARTITION BY user_id ORDER BY wall_ms)),
        s AS (SELECT user_id, CASE WHEN wg IS NULL THEN 'first' WHEN wg > 100000 THEN 'gap' WHEN mg < 0 THEN 'seekBack' WHEN mg = 0 THEN 'stalled' WHEN mg > wg * 0.0002::DOUBLE + 2 THEN 'jump' ELSE 'playing' END AS status FROM d) SELECT user_id, status, count(*) AS n FROM s GROUP BY 1, 2""",
}

_STEPS = f"""{_ITEMS}, st AS (SELECT user_id, item_id, ['matched', 'matched', 'sourceOnly', 'targetOnly', 'ambiguous'][item_id * 7 % 5 + 1] AS kind, item_id % 90 AS cost, row_number() OVER (PARTITION BY user_id ORDER BY item_id) AS n FROM items),
    steps0 AS (SELECT *, n * 10 AS source_start_ms, n * 10 + 10 AS source_end_ms, n * 20 AS target_start_ms, n * 20 + 20 AS target_end_ms, kind IN ('sourceOnly', 'targetOnly') AS gap FROM st)"""
_GOLD = f"{_ITEMS}, sp AS (SELECT user_id AS case_id, CASE WHEN item_id % 3 = 0 THEN 'sourceOnly' ELSE 'targetOnly' END AS kind, item_id, t_ms AS a, t_ms + 5000 + item_id % 100 * 10 AS z, asset_id FROM items)"

ORACLE |= {
    "title_scores": """WITH p AS (SELECT p_partkey, list_filter(string_split(lower(p_name), ' '), lambda x: length(x) >= 2) AS tok, trim(regexp_replace(regexp_replace(lower(concat_ws(' ', p_name, 'E', p_partkey % 40 + p_partkey % 2)), '\\.[a-z0-9]+$', ''), '[^a-z0-9]+', ' ', 'g')) AS t, p_partkey % 2 = 0 AS found FROM part),
        s AS (SELECT *, len(list_filter(tok, lambda x: contains(t, x))) AS h, len(tok) AS n FROM p), r AS (SELECT p_partkey, CASE WHEN h = 0 AND NOT found THEN CASE WHEN n = 0 THEN 0.5::DOUBLE ELSE 0.35::DOUBLE END ELSE least(1.0::DOUBLE, 0.55::DOUBLE + CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE h / n END * 0.35::DOUBLE + CASE WHEN found THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END) END AS score FROM s)
        SELECT p_partkey, round(score, 6) AS score, CASE WHEN score >= 0.75::DOUBLE THEN 'positive' WHEN score >= 0.5::DOUBLE THEN 'neutral' WHEN score >= 0.25::DOUBLE THEN 'warning' ELSE 'negative' END AS state FROM r""",
    "ladders": """WITH o AS (SELECT o_custkey, count(*) AS n, abs(CAST(floor(sum(o_totalprice)) AS BIGINT) - 2000000) AS d FROM orders GROUP BY 1)
        SELECT o_custkey, CASE WHEN d <= 60000 OR d / 4000000 <= 0.02::DOUBLE THEN 1.0::DOUBLE WHEN d <= 300000 OR d / 4000000 <= 0.1::DOUBLE THEN 0.72::DOUBLE WHEN d <= 900000 OR d / 4000000 <= 0.25::DOUBLE THEN 0.42::DOUBLE ELSE 0.12::DOUBLE END AS duration,
               CASE WHEN n >= 20 THEN 1.0::DOUBLE WHEN n >= 8 THEN 0.72::DOUBLE WHEN n >= 3 THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END AS density FROM o""",
    "search_ranking": """WITH c AS (SELECT c_custkey, lower(c_name) AS n, c_custkey % 5 AS s, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 11 END AS e, c_nationkey % 2 = 0 AS ep, c_acctbal > 0 AS d FROM customer)
        SELECT c_custkey, CAST(CASE WHEN n = 'customer#0000' THEN 80 WHEN contains(n, 'customer#0000') THEN 40 WHEN contains('customer#0000', n) THEN 20 ELSE 0 END + CASE WHEN s = 3 THEN 30 ELSE -10 END + CASE WHEN e IS NULL THEN 0 WHEN e = 4 THEN 45 ELSE -10 END + CASE WHEN ep THEN 10 ELSE 0 END + CASE WHEN d THEN 2 ELSE 0 END AS BIGINT) AS score FROM c""",
    "redacted_texts": "SELECT s_suppkey, 'at [hidden]' || s_name || '.mkv or [hidden]x [hidden sha-256]' AS t FROM supplier",
    "unique_file_names": "WITH p AS (SELECT p_partkey, trim(regexp_replace(p_brand || '_' || p_type, '\\s+', ' ', 'g')) AS name, row_number() OVER (PARTITION BY lower(p_brand || '_' || p_type) ORDER BY p_partkey) AS n FROM part) SELECT p_partkey, name, CASE WHEN n = 1 THEN name ELSE name || ' (' || n || ')' END AS unique_name FROM p",
    "string_hashes": "SELECT c_custkey, list_reduce(list_transform(range(1, length(c_name) + 1), lambda i: CAST(ascii(c_name[i]) AS BIGINT)), lambda h, c: (h * 31 + c) % 4294967296, 0::BIGINT) AS h FROM customer",
    "boundary_candidates": f"""WITH {_GOLD} SELECT g.case_id, g.kind, g.item_id AS gold_id, p.item_id AS predicted_id, greatest(abs(g.a - p.a), abs(g.z - p.z)) AS error_ms FROM sp g JOIN sp p ON g.case_id = p.case_id AND g.kind = p.kind
        WHERE g.asset_id IN ('click', 'view') AND p.asset_id IN ('purchase', 'error') AND greatest(abs(g.a - p.a), abs(g.z - p.z)) <= 3600000""",
    "occupancy_conflicts": f"""WITH {_SHORT}, o AS (SELECT user_id AS medium, event_id % 20 AS owner, event_id % 20 % 4 AS reuse, s, e FROM short)
        SELECT a.medium, a.owner AS first_owner, b.owner AS second_owner, CAST(sum(least(a.e, b.e) - greatest(a.s, b.s)) AS BIGINT) AS overlap_ms FROM o a JOIN o b ON a.medium = b.medium AND a.owner < b.owner AND a.reuse <> b.reuse AND a.s < b.e AND b.s < a.e GROUP BY 1, 2, 3 HAVING sum(least(a.e, b.e) - greatest(a.s, b.s)) > 250""",
    "anchor_interpolation": f"""WITH {_ITEMS}, k AS (SELECT user_id, t_ms, min(item_id) AS v FROM items WHERE asset_id = 'view' GROUP BY 1, 2),
        b AS (SELECT c.item_id, c.t_ms, (SELECT max(t_ms) FROM k WHERE k.user_id = c.user_id AND k.t_ms <= c.t_ms) AS x1, (SELECT min(t_ms) FROM k WHERE k.user_id = c.user_id AND k.t_ms > c.t_ms) AS x2, c.user_id FROM items c WHERE asset_id = 'click')
        SELECT item_id, round(coalesce(CASE WHEN x1 = b.t_ms THEN k1.v::DOUBLE ELSE k1.v + (b.t_ms - x1) / (x2 - x1) * (k2.v - k1.v) END, -1.0::DOUBLE), 4) AS y FROM b LEFT JOIN k k1 ON k1.user_id = b.user_id AND k1.t_ms = x1 LEFT JOIN k k2 ON k2.user_id = b.user_id AND k2.t_ms = x2""",
    "calibrated_scores": f"""WITH {_ITEMS}, v AS (SELECT item_id, value / 400 AS p FROM items) SELECT item_id, round(CASE WHEN p > 1 THEN -1.0::DOUBLE WHEN p <= 0.25::DOUBLE THEN 0.1::DOUBLE + p / 0.25::DOUBLE * 0.3::DOUBLE WHEN p <= 0.6::DOUBLE THEN 0.4::DOUBLE + (p - 0.25::DOUBLE) / 0.35::DOUBLE * 0.15::DOUBLE ELSE 0.55::DOUBLE + (p - 0.6::DOUBLE) / 0.4::DOUBLE * 0.4::DOUBLE END, 6) AS p FROM v""",
    "collapse_mixed": f"""WITH {_STEPS}, f AS (SELECT *, CASE WHEN gap AND lag(gap) OVER w THEN 0 ELSE 1 END AS fresh FROM steps0 WINDOW w AS (PARTITION BY user_id ORDER BY item_id)),
        r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY item_id ROWS UNBOUNDED PRECEDING) AS run FROM f), m AS (SELECT *, bool_or(kind = 'sourceOnly') OVER (PARTITION BY user_id, run) AND bool_or(kind = 'targetOnly') OVER (PARTITION BY user_id, run) AS mixed FROM r)
        SELECT user_id, min(item_id) AS item_id, CASE WHEN bool_and(mixed) THEN 'ambiguous' ELSE min(kind) END AS kind, min(source_start_ms) AS source_start_ms, max(source_end_ms) AS source_end_ms, min(target_start_ms) AS target_start_ms, max(target_end_ms) AS target_end_ms, CAST(sum(cost) AS BIGINT) AS cost FROM m GROUP BY user_id, run, CASE WHEN mixed THEN -1 ELSE item_id END""",
    "merge_steps": f"""WITH {_STEPS}, f AS (SELECT *, CASE WHEN lag(kind) OVER w = kind THEN 0 ELSE 1 END AS fresh FROM steps0 WINDOW w AS (PARTITION BY user_id ORDER BY item_id)), r AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY item_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS span FROM f)
        SELECT user_id, span, min(kind) AS kind, min(source_start_ms) AS source_start_ms, max(source_end_ms) AS source_end_ms, min(target_start_ms) AS target_start_ms, max(target_end_ms) AS target_end_ms FROM r GROUP BY 1, 2""",
    "local_consensus": f"""WITH {_ITEMS}, m AS (SELECT asset_id, t_ms // 3600000 AS a, item_id % 7 * 100 // 250 AS o, item_id % 40 AS s, user_id % 30 AS t FROM items), c AS (SELECT DISTINCT asset_id, a AS cell, o AS offset_cell FROM m)
        SELECT c.asset_id, cell, offset_cell, count(DISTINCT s) AS n_sources, count(DISTINCT t) AS n_targets FROM c JOIN m ON m.asset_id = c.asset_id AND m.a BETWEEN cell - 2 AND cell + 2 AND m.o BETWEEN offset_cell - 1 AND offset_cell + 1 GROUP BY 1, 2, 3 HAVING count(DISTINCT s) >= 3 AND count(DISTINCT t) >= 3""",
    "best_two_margin": "WITH r AS (SELECT l_suppkey, l_extendedprice, row_number() OVER w AS r, lead(l_extendedprice) OVER w AS s FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey)) SELECT l_suppkey, l_extendedprice, coalesce(s, 0.0::DOUBLE) AS second, round(l_extendedprice - coalesce(s, 0.0::DOUBLE), 2) AS margin FROM r WHERE r = 1",
    "region_means": f"WITH {_ITEMS}, p AS (SELECT asset_id, user_id % 32 AS x, item_id % 18 AS y, value FROM items) SELECT asset_id, (y - 2) * 2 // 12 * 4 + x * 4 // 32 AS region, round(avg(value), 6) AS mean FROM p WHERE y BETWEEN 2 AND 13 GROUP BY 1, 2",
    "correlations": f"WITH {_FRAMES}, c AS (SELECT vec_id, list_transform(v, lambda x: x - list_avg(v)) AS c FROM frames) SELECT a.vec_id, round(list_dot_product(a.c, b.c) / sqrt(list_dot_product(a.c, a.c) * list_dot_product(b.c, b.c)), 6) AS r FROM c a, c b WHERE b.vec_id = 0",
    "candidate_decisions": """WITH c AS (SELECT o_orderkey AS candidate_id, ['pending', 'accepted', 'rejected', 'blocked'][o_orderkey % 4 + 1] AS state FROM orders), l AS (SELECT l_orderkey AS candidate_id, l_linenumber * 1000000 + l_partkey AS seq, min(CASE WHEN l_quantity > 25 THEN 'accepted' ELSE 'pending' END) AS t FROM lineitem GROUP BY 1, 2),
        d AS (SELECT candidate_id, list(t ORDER BY seq, t) AS ts FROM l GROUP BY 1),
        f AS (SELECT c.candidate_id, list_reduce(list_prepend(state || ' 0', coalesce(ts, [])), lambda s, t: CASE WHEN split_part(s, ' ', 1) = 'pending' AND t IN ('accepted', 'rejected', 'blocked') OR split_part(s, ' ', 1) <> 'pending' AND t = 'pending'
              THEN t || ' ' || split_part(s, ' ', 2) ELSE split_part(s, ' ', 1) || ' ' || (CAST(split_part(s, ' ', 2) AS BIGINT) + 1) END) AS s FROM c LEFT JOIN d USING (candidate_id))
        SELECT candidate_id, CAST(split_part(s, ' ', 2) AS BIGINT) AS refused, split_part(s, ' ', 1) AS state FROM f""",
    "superseded_maps": "WITH m AS (SELECT o_orderkey AS map_id, o_custkey % 50 AS s, o_custkey % 7 AS t, o_orderkey % 100 AS revision, CASE WHEN o_orderstatus = 'F' THEN 'confirmed' ELSE 'candidate' END AS state FROM orders) SELECT map_id, CASE WHEN state = 'confirmed' AND row_number() OVER (PARTITION BY s, t, state ORDER BY revision DESC, map_id) > 1 THEN 'superseded' ELSE state END AS state FROM m",
    "shifted_spans": f"WITH {L.SPANS.cte()} SELECT map_id, span_index, kind, source_start_ms + 1000 AS source_start_ms, source_end_ms + 1000 AS source_end_ms, target_start_ms - 500 AS target_start_ms, target_end_ms - 500 AS target_end_ms FROM spans",
    "split_span": f"""WITH {L.SPANS.cte()}, h AS (SELECT *, map_id = 'click' AND span_index = 3 AS hit, {9 * DAY + 1} AS cut_at, {8 * DAY} + (2 * CAST({9 * DAY + 1 - 7 * DAY} AS HUGEINT) * {3 * DAY} + {5 * DAY}) // {10 * DAY} AS im FROM spans),
        p AS (SELECT map_id, kind, span_index AS i, 0 AS part, source_start_ms, CASE WHEN hit THEN cut_at ELSE source_end_ms END AS source_end_ms, target_start_ms, CASE WHEN hit THEN CAST(im AS BIGINT) ELSE target_end_ms END AS target_end_ms FROM h UNION ALL SELECT map_id, kind, span_index, 1, cut_at, source_end_ms, CAST(im AS BIGINT), target_end_ms FROM h WHERE hit)
        SELECT map_id, kind, source_start_ms, source_end_ms, target_start_ms, target_end_ms, row_number() OVER (PARTITION BY map_id ORDER BY i, part) - 1 AS span_index FROM p""",
    "clipped_proposal": f"WITH {_ITEMS} SELECT item_id, t_ms, least({11 * DAY}, greatest({10 * DAY}, t_ms - 3600000)) AS range_start_ms, least({11 * DAY}, greatest({10 * DAY}, t_ms + 3600000)) AS range_end_ms FROM items WHERE t_ms BETWEEN {10 * DAY} AND {11 * DAY}",
}
