"""Solvers for what no relational plan expresses: one bounded problem (a project, a pair, a case) is one group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the assignment score.
OVERLAP_MS, INVERSION, REPEATED, AMBIGUOUS, EXACT, BEAM = 250, 0.08, 0.3, 0.08, 18, 256


def _weights(h: pd.DataFrame) -> np.ndarray:
    return (h.score * (0.35 + 0.65 * h.unique_coverage) + 0.2 * h.alternative_margin - REPEATED * h.repeated_only.astype(float)).to_numpy(float)


def _relations(h: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hard conflicts, order penalties) as matrices over the hypotheses."""
    n = len(h)
    clash, penalty = np.zeros((n, n), bool), np.zeros((n, n))
    group = h.alternative_group.to_numpy(object)
    clash |= np.array([[a is not None and a == a and a == b for b in group] for a in group], bool).reshape(n, n)
    for side, other in (("source", "target"), ("target", "source")):
        media, a, z = h[f"{side}_media"].to_numpy(), h[f"{side}_start_ms"].to_numpy(), h[f"{side}_end_ms"].to_numpy()
        same = media[:, None] == media[None, :]
        clash |= same & (np.minimum(z[:, None], z[None, :]) - np.maximum(a[:, None], a[None, :]) > OVERLAP_MS)
        hint = h[f"{other}_order"].to_numpy(float)
        crossed = np.sign(a[:, None] - a[None, :]) * np.sign(hint[:, None] - hint[None, :]) < 0
        penalty = np.where((penalty == 0) & same & crossed, INVERSION, penalty)
    np.fill_diagonal(clash, True)
    return clash, penalty


def assign(h: pd.DataFrame) -> pd.DataFrame:
    """Best conflict-free subset of one project's hypotheses, and the best one that has a relation it lacks.

    Up to EXACT hypotheses by branch and bound, beyond by a beam. Returns the hypotheses with selected,
    in_runner_up, reason, total, margin, ambiguous and exact.
    """
    h = h.sort_values("id").reset_index(drop=True)
    free = np.flatnonzero(~h.blocked.to_numpy(bool))
    w = _weights(h)
    clash, penalty = _relations(h)
    exact = len(free) <= EXACT
    order = sorted(free, key=lambda i: (-w[i], -h.unique_coverage[i], h.id[i]))
    ids = h.id.tolist()

    def better(a: tuple, b: tuple | None) -> bool:
        return b is None or a[0] > b[0] + 1e-12 or (abs(a[0] - b[0]) <= 1e-12 and sorted(ids[i] for i in a[1]) < sorted(ids[i] for i in b[1]))

    def search(lacking: set[int] | None) -> tuple | None:
        new = lambda s: lacking is None or any(i not in lacking for i in s)
        best: tuple | None = None
        if exact:
            rest = np.append(np.cumsum(np.maximum(w[order], 0)[::-1])[::-1], 0) if order else np.zeros(1)
            stack = [(0, (), 0.0)]
            while stack:
                k, chosen, score = stack.pop()
                if best is not None and score + rest[k] < best[0] - 1e-12:
                    continue
                if k == len(order):
                    if new(chosen) and better((score, chosen), best):
                        best = (score, chosen)
                    continue
                i = order[k]
                stack.append((k + 1, chosen, score))
                if not any(clash[i, j] for j in chosen):
                    more = w[i] - sum(penalty[i, j] for j in chosen)
                    if more > 0:
                        stack.append((k + 1, (*chosen, i), score + more))
            return best
        beam = [(0.0, ())]
        rank = lambda s: (-s[0], sorted(ids[i] for i in s[1]))
        for i in order:
            grown = list(beam)
            for score, chosen in beam:
                if not any(clash[i, j] for j in chosen):
                    more = w[i] - sum(penalty[i, j] for j in chosen)
                    if more > 0:
                        grown.append((score + more, (*chosen, i)))
            grown.sort(key=rank)
            if lacking is None:
                beam = grown[:BEAM]
            else:
                beam = sorted([s for s in grown if not new(s[1])][: BEAM // 2] + [s for s in grown if new(s[1])][: BEAM // 2], key=rank)
        return next((s for s in beam if new(s[1])), None)

    top = search(None) or (0.0, ())
    other = search(set(top[1]))
    if not exact and other and other[0] > top[0]:
        top = other
        other = search(set(top[1]))
    chosen = set(top[1])
    margin = (top[0] - other[0]) / max(abs(top[0]), 1e-9) if other else (1.0 if chosen and exact else None)
    unresolved = any(i not in chosen and w[i] > 0 for i in free)
    ambiguous = (not exact and unresolved and other is None) or (other is not None and margin is not None and margin < AMBIGUOUS)

    def reason(i: int) -> str | None:
        if i in chosen:
            return None
        if h.blocked[i]:
            return "blocked"
        g = h.alternative_group[i]
        if g is not None and g == g and any(h.alternative_group[j] == g for j in chosen):
            return "samePairAlternative"
        for side in ("source", "target"):
            for j in chosen:
                if h[f"{side}_media"][i] == h[f"{side}_media"][j] and min(h[f"{side}_end_ms"][i], h[f"{side}_end_ms"][j]) - max(h[f"{side}_start_ms"][i], h[f"{side}_start_ms"][j]) > OVERLAP_MS:
                    return f"{side}Overlap"
        return "notInBestCombination"

    n = len(h)
    return pd.DataFrame({"project": h.project, "id": h.id, "selected": [i in chosen for i in range(n)], "in_runner_up": [bool(other) and i in other[1] for i in range(n)], "reason": [reason(i) for i in range(n)], "total": top[0], "margin": margin, "ambiguous": bool(ambiguous), "exact": exact})


# States of small projects that are in memory at once.
STATES = 1 << 20
_NEEDED = ["source_media", "target_media", "source_start_ms", "source_end_ms", "target_start_ms", "target_end_ms", "score", "unique_coverage", "alternative_margin", "repeated_only", "blocked"]
_ASSIGNED = "project long, id string, selected boolean, in_runner_up boolean, reason string, total double, margin double, ambiguous boolean, exact boolean"


def assignments(hypotheses: DataFrame) -> DataFrame:
    """``assign`` for each project, which holds what one person's media give. Small projects stream by, thousands at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for h in batches:
            last = h.project.iloc[-1] if len(h) else None
            tail = (h.project.isna() if pd.isna(last) else h.project == last).to_numpy() if len(h) else np.zeros(0, bool)
            first = held[0].project.iloc[0] if held else None
            if len(h) and not (held and tail.all() and (first == last or pd.isna(first) and pd.isna(last))):
                whole = pd.concat([*held, h[~tail]], ignore_index=True)
                held = []
                if len(whole):
                    yield from _assigned(whole)
            if len(h):
                held.append(h[tail])
        if held:
            yield from _assigned(pd.concat(held, ignore_index=True))

    return hypotheses.repartition("project").sortWithinPartitions("project", "id").mapInPandas(run, _ASSIGNED)


def _assigned(h: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Whole projects, sorted by project and id: those of up to EXACT hypotheses without nulls by size, others one by one."""
    new = np.append(True, (h.project.to_numpy()[1:] != h.project.to_numpy()[:-1]) & ~(h.project.isna().to_numpy()[1:] & h.project.isna().to_numpy()[:-1]))
    at = np.cumsum(new) - 1
    odd = h[[*_NEEDED, "project", "id"]].isna().any(axis=1).to_numpy() | (np.append(False, h.id.to_numpy()[1:] == h.id.to_numpy()[:-1]) & ~new)
    size = np.bincount(at)
    small = (size <= EXACT) & (np.bincount(at, odd) == 0)
    for n in np.unique(size[small]):
        rows = np.flatnonzero((small & (size == n))[at])
        step = n * max(1, STATES >> int(n))
        for k in range(0, len(rows), step):
            yield _assign_equal(h.iloc[rows[k : k + step]], int(n))
    for k in np.flatnonzero(~small):
        yield assign(h[at == k])


def _assign_equal(h: pd.DataFrame, n: int) -> pd.DataFrame:
    """``assign`` for projects of n hypotheses each: all sets that it would grow, as bits, a hypothesis at a time."""
    col = lambda c, kind: h[c].to_numpy().astype(kind).reshape(-1, n)
    w, cover, free = _weights(h).reshape(-1, n), col("unique_coverage", float), ~col("blocked", bool)
    group = pd.factorize(h.alternative_group)[0].reshape(-1, n)
    bits = 1 << np.arange(n, dtype=np.int64)
    mask = lambda m: (m * bits).sum(2)
    across = lambda x: (x[:, :, None], x[:, None, :])
    (ga, gb), crossing, over = across(group), False, {}
    for side, other in (("source", "target"), ("target", "source")):
        (ma, mb), (a, b), (y, z) = (across(x) for x in (pd.factorize(h[f"{side}_media"])[0].reshape(-1, n), col(f"{side}_start_ms", np.int64), col(f"{side}_end_ms", np.int64)))
        p, q = across(col(f"{other}_order", float))
        over[side] = mask((ma == mb) & (np.minimum(y, z) - np.maximum(a, b) > OVERLAP_MS))
        crossing = crossing | (ma == mb) & (np.sign(a - b) * np.sign(p - q) < 0)
    alike, crossing = mask((ga == gb) & (ga >= 0)), mask(crossing)
    clash = alike | over["source"] | over["target"] | bits
    penalty = np.cumsum([0.0, *[INVERSION] * n])
    order = np.lexsort((np.broadcast_to(np.arange(n), w.shape), -cover, -w, ~free))
    m = len(w)
    own, chosen, score = np.arange(m), np.zeros(m, np.int64), np.zeros(m)
    for k in range(n):
        i = order[own, k]
        more = w[own, i] - penalty[np.bitwise_count(crossing[own, i] & chosen)]
        fit = free[own, i] & (clash[own, i] & chosen == 0) & (more > 0)
        own, chosen, score = np.append(own, own[fit]), np.append(chosen, chosen[fit] | bits[i[fit]]), np.append(score, score[fit] + more[fit])
    # Lists of ids in order compare as these numbers: a place that is held, one before others, one after all.
    rank = np.zeros(len(own), np.int64)
    for k in range(n):
        rank = rank * 3 + np.where(chosen >> k & 1, 1, np.where(chosen >> (k + 1), 2, 0))

    def best(of: np.ndarray) -> np.ndarray:
        """The state of each project with the highest score, of equals the first by ids; -1 without any."""
        high, out = np.full(m, -np.inf), np.full(m, -1)
        np.maximum.at(high, own[of], score[of])
        tied = of[score[of] >= high[own[of]] - 1e-12]
        tied = tied[np.lexsort((rank[tied], own[tied]))][::-1]
        out[own[tied]] = tied
        return out

    top = best(np.arange(len(own)))
    got, total = chosen[top], score[top]
    second = best(np.flatnonzero(chosen & ~got[own]))
    any_second = second >= 0
    margin = np.where(any_second, (total - score[second]) / np.maximum(np.abs(total), 1e-9), np.where(got > 0, 1.0, np.nan))
    each = lambda x: np.repeat(x, n)
    isin, hit = (got[:, None] & bits) > 0, lambda x: x & got[:, None] > 0
    why = np.select([isin, ~free, hit(alike), hit(over["source"]), hit(over["target"])], [0, 1, 2, 3, 4], 5).ravel()
    names = np.array([None, "blocked", "samePairAlternative", "sourceOverlap", "targetOverlap", "notInBestCombination"], object)
    runner = any_second[:, None] & ((chosen[second][:, None] & bits) > 0)
    known = pd.Series(each(margin)).astype(object).where(~np.isnan(each(margin)), None)
    return pd.DataFrame({"project": h.project.to_numpy(), "id": h.id.to_numpy(), "selected": isin.ravel(), "in_runner_up": runner.ravel(), "reason": names[why], "total": each(total), "margin": known, "ambiguous": each(any_second & (margin < AMBIGUOUS)), "exact": True})


def match_most(cost: dict[tuple[int, int], float], n: int, m: int) -> list[tuple[int, int]]:
    """As many pairs as possible, and of those the cheapest: shortest augmenting paths by Bellman-Ford."""
    left, right = [-1] * n, [-1] * m
    edges = sorted(cost)
    while True:
        dist_l = [0.0 if left[i] < 0 else float("inf") for i in range(n)]
        dist_r, via = [float("inf")] * m, [-1] * m
        changed = True
        while changed:
            changed = False
            for i, j in edges:
                if left[i] != j and dist_l[i] + cost[i, j] < dist_r[j] - 1e-12:
                    dist_r[j], via[j] = dist_l[i] + cost[i, j], i
                    changed = True
                    k = right[j]
                    if k >= 0 and dist_r[j] - cost[k, j] < dist_l[k] - 1e-12:
                        dist_l[k] = dist_r[j] - cost[k, j]
        free = [j for j in range(m) if right[j] < 0 and dist_r[j] < float("inf")]
        if not free:
            return sorted((i, j) for i, j in enumerate(left) if j >= 0)
        j = min(free, key=lambda j: (dist_r[j], j))
        while j >= 0:
            i = via[j]
            right[j], left[i], j = i, j, left[i]


def near_in_time(g: DataFrame, p: DataFrame, keys: list[str], within: int) -> DataFrame:
    """Pairs of rows of equal keys whose times (``g`` and ``p``) differ by ``within`` at most, from a join on time bins.
    _stretch: number of the pair's stretch of time in its key, in which each time is at most ``within`` after the last.

    The union is dealt out anew: Spark 4.1 takes a union of equally partitioned sides for partitioned itself, and
    windows over it were seen to miss rows. The distinct and the window then need no shuffle of their own."""
    width = max(1, within)
    every = g.select(*keys, F.col("g").alias("_t")).unionByName(p.select(*keys, F.col("p").alias("_t"))).repartition(*keys).distinct()
    w = Window.partitionBy(*keys).orderBy("_t")
    breaks = every.withColumn("_new", F.coalesce((F.col("_t") - F.lag("_t").over(w) > within).cast("int"), F.lit(0)))
    stretch = breaks.select(*keys, F.col("_t").alias("g"), F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_stretch"))
    gb = g.join(stretch, [*keys, "g"]).withColumn("_bin", F.floor(F.col("g") / width))
    pb = p.withColumn("_bin", F.explode(F.array(*[F.floor(F.col("p") / width) + k for k in (-1, 0, 1)])))
    return gb.join(pb, [*keys, "_bin"]).filter(F.abs(F.col("g") - F.col("p")) <= within).drop("_bin")


def match_events(gold: DataFrame, predicted: DataFrame, case: str = "case_id", kind: str = "kind", t: str = "t_ms", event_id: str = "event_id", within: int = 2_000) -> DataFrame:
    """Gold and predicted events of one case and kind, matched one to one within a tolerance: most pairs first, then
    least total distance. Candidates come from a join on time bins. Events that no other one within the tolerance joins
    in time are solved apart: a group is a stretch of time in which each event is at most ``within`` after the last."""
    g = gold.select(case, kind, F.col(event_id).alias("gold_id"), F.col(t).alias("g"))
    p = predicted.select(case, kind, F.col(event_id).alias("predicted_id"), F.col(t).alias("p"))
    near = near_in_time(g, p, [case, kind], within).select(case, kind, "_stretch", "gold_id", "predicted_id", F.abs(F.col("g") - F.col("p")).cast("double").alias("error_ms"))

    # A list for each stretch, which is short as a rule: one Arrow batch holds thousands.
    pair = F.struct("gold_id", "predicted_id", "error_ms")
    listed = near.groupBy(case, kind, "_stretch").agg(F.collect_list(pair).alias("c"))

    @F.pandas_udf(listed.schema["c"].dataType)
    def matched(lists: pd.Series) -> pd.Series:
        out = []
        for c in lists:
            if len(c) > 1:
                gi, pi = ({v: i for i, v in enumerate(sorted({x[k] for x in c}))} for k in ("gold_id", "predicted_id"))
                pairs = set(match_most({(gi[x["gold_id"]], pi[x["predicted_id"]]): x["error_ms"] for x in c}, len(gi), len(pi)))
                c = [x for x in c if (gi[x["gold_id"]], pi[x["predicted_id"]]) in pairs]
            out.append(list(c))
        return pd.Series(out, dtype=object)

    return listed.select(case, kind, F.inline(matched("c")))
