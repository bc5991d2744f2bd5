"""The frontier of fine scoring: which candidates must still be scored before the best assignment is proven.

A case has pairs, a pair has candidates, and at most one candidate of a pair is chosen. A candidate has an upper bound
for its score in millionths from a coarse stage, and a state: ``unresolved`` (it can be scored), ``blocked`` (it cannot,
for now), ``scored`` (with a score), ``ineligible`` (it counts for nothing). Scored candidates of two pairs exclude
each other where they occupy the same space for longer than a tolerance.

The plan: exclusions are overlap joins on time bins. Pairs that exclude nothing are solved by an aggregate; the others
fall into components, found by joins, and only a component is one problem. Totals, the runner-up, the bound of all
assignments that need an open candidate, the proof and the next batch are aggregates and joins again. So a case with any
number of candidates is as many tasks as it has components.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph, intervals

# Tolerated overlap, candidates in a batch, bounds of a component's search.
OVERLAP_MS, BATCH, STATES, EXPANSIONS = 250, 16, 2_000_000, 8_000_000
ID = ["case_id", "pair", "candidate"]


def exclusions(candidates: DataFrame, occupancy: DataFrame, tolerance: int = OVERLAP_MS, width: int = 60_000) -> DataFrame:
    """(case_id, pair, candidate, other_pair, other), both ways, for scored candidates of different pairs that occupy one
    space of one axis for longer than the tolerance. Equal reuse groups share their space."""
    scored = candidates.filter("state = 'scored'").select(*ID)
    spans = occupancy.join(scored, ID).withColumn("_row", F.struct("pair", "candidate", "start_ms", "reuse"))
    met = intervals.overlap_pairs(spans, ["case_id", "axis", "space"], "_row", "start_ms", "end_ms", width).filter(F.col("overlap") > tolerance)
    apart = met.filter((F.col("left_id.pair") != F.col("right_id.pair")) & ~F.coalesce(F.col("left_id.reuse") == F.col("right_id.reuse"), F.lit(False)))
    one = apart.select("case_id", *[F.col(f"{s}_id.{c}").alias(n) for s, names in (("left", ("pair", "candidate")), ("right", ("other_pair", "other"))) for c, n in zip(("pair", "candidate"), names)])
    other = one.select("case_id", F.col("other_pair").alias("pair"), F.col("other").alias("candidate"), F.col("pair").alias("other_pair"), F.col("candidate").alias("other"))
    return one.unionByName(other).distinct()


def top_two(choices: dict[int, list[tuple[int, int]]], clash: set[tuple[tuple[int, int], tuple[int, int]]], states: int = STATES, expansions: int = EXPANSIONS) -> list[tuple[int, list[tuple[int, int]]]] | None:
    """The two best assignments (total, [(pair, candidate)]) of a component: depth first, best candidates first, cut where
    even the best scores of the remaining pairs cannot reach the runner-up. choices: per pair (score, candidate); clash:
    excluded ((pair, candidate), (pair, candidate)), both ways. None beyond the bounds. Of equal totals the list that is
    smaller by its elements comes first; a list that goes on comes before one that ends."""
    pairs = sorted(choices)
    order = {p: sorted(choices[p], key=lambda c: (-c[0], c[1])) for p in pairs}
    rest = [0] * (len(pairs) + 1)
    for k in range(len(pairs) - 1, -1, -1):
        rest[k] = rest[k + 1] + max(0, order[pairs[k]][0][0])
    end = (float("inf"),)
    found: list[tuple[tuple, int, list[tuple[int, int]]]] = []
    seen = tried = 0
    stack: list[tuple[int, int, tuple]] = [(0, 0, ())]
    while stack:
        k, total, chosen = stack.pop()
        seen += 1
        if seen > states:
            return None
        if len(found) == 2 and total + rest[k] < found[1][1]:
            continue
        if k == len(pairs):
            found = sorted([*found, ((-total, (*chosen, end)), total, list(chosen))])[:2]
            continue
        grown = []
        for score, c in order[pairs[k]]:
            tried += 1
            if not any(((pairs[k], c), x) in clash for x in chosen):
                grown.append((k + 1, total + score, (*chosen, (pairs[k], c))))
        tried += 1
        if tried > expansions:
            return None
        grown.append((k + 1, total, chosen))
        stack.extend(reversed(grown))
    return [(total, chosen) for _, total, chosen in found]


_FOUND = "case_id long, component long, rank int, total long, pair long, candidate long, exhausted boolean, at long, smaller boolean"


def _first_difference(best: list[tuple[int, int]], second: list[tuple[int, int]]) -> tuple[int, bool]:
    """Where the second list leaves the first, and whether with the smaller element."""
    k = 0
    while k < len(best) and k < len(second) and best[k] == second[k]:
        k += 1
    ends = (float("inf"),)
    x, y = (s[k] if k < len(s) else ends for s in (best, second))
    return int(min(x, y)[0]), y < x


def _search(key: tuple, c: pd.DataFrame, e: pd.DataFrame, states: int, expansions: int) -> pd.DataFrame:
    choices: dict[int, list[tuple[int, int]]] = {}
    for p, i, s in zip(c.pair, c.candidate, c.score):
        choices.setdefault(int(p), []).append((int(s), int(i)))
    clash = {((int(a), int(b)), (int(x), int(y))) for a, b, x, y in zip(e.pair, e.candidate, e.other_pair, e.other)}
    found = top_two(choices, clash, states, expansions) if choices else []
    if found is None:
        return pd.DataFrame([(*key, 1, None, None, None, True, None, None)], columns=[x.split()[0] for x in _FOUND.split(", ")])
    at, smaller = _first_difference(found[0][1], found[1][1]) if len(found) > 1 else (None, None)
    rows = [(*key, r + 1, total, *x, False, at, smaller) for r, (total, chosen) in enumerate(found) for x in (chosen or [(None, None)])]
    return pd.DataFrame(rows, columns=[x.split()[0] for x in _FOUND.split(", ")]).astype(object)


def solved(candidates: DataFrame, occupancy: DataFrame, tolerance: int = OVERLAP_MS, states: int = STATES, expansions: int = EXPANSIONS) -> DataFrame:
    """The two best assignments of every component of scored candidates: a row for each chosen candidate (one with nulls
    for an empty choice), with the rank and total; exhausted where the search met its bounds."""
    scored = candidates.filter("state = 'scored'").select(*ID, "score")
    clash = graph.cut(exclusions(candidates, occupancy, tolerance))
    parts = graph.components(clash, "case_id", "pair", "other_pair").withColumnRenamed("node", "pair")
    # Pairs that exclude nothing: their best candidate, and the second best or none.
    free = scored.join(parts, ["case_id", "pair"], "left_anti")
    w = Window.partitionBy("case_id", "pair").orderBy(F.desc("score"), "candidate")
    none = F.struct(F.lit(0).cast("long").alias("score"), F.lit(None).cast("long").alias("candidate"))
    ranked = free.withColumn("rank", F.row_number().over(w)).filter("rank <= 2").groupBy("case_id", "pair").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "candidate"))).alias("c"))
    of = lambda k: F.struct(F.col("c")[k]["score"].cast("long").alias("score"), F.col("c")[k]["candidate"].alias("candidate"))
    two = ranked.select("case_id", "pair", F.posexplode(F.array(of(0), F.when(F.size("c") > 1, of(1)).otherwise(none))).alias("k", "x"), F.expr("size(c) > 1 and c[1].candidate < c[0].candidate").alias("smaller"))
    single = two.select(
        "case_id", F.col("pair").alias("component"), (F.col("k") + 1).cast("int").alias("rank"), F.col("x.score").alias("total"), F.when(F.col("x.candidate").isNotNull(), F.col("pair")).alias("pair"), F.col("x.candidate").alias("candidate"),
        F.lit(False).alias("exhausted"), F.col("pair").alias("at"), "smaller",
    )
    own = scored.join(parts, ["case_id", "pair"]).groupBy("case_id", "component")
    # Fresh columns, as both sides come from one relation.
    edges = clash.join(parts, ["case_id", "pair"]).select(*[F.col(c).alias(c) for c in ("case_id", "component", "pair", "candidate", "other_pair", "other")]).groupBy("case_id", "component")
    run = lambda key, c, e: _search(key, c, e, states, expansions)
    return single.unionByName(own.cogroup(edges).applyInPandas(run, _FOUND))


def optimistic(candidates: DataFrame) -> DataFrame:
    """(case_id, pair, candidate, open, worth, state): the best assignment with an open candidate, were every open one worth
    its bound and nothing excluded. A pair's best candidate is taken (of equals the smallest), but for the pair that gives way
    to an open one at the least loss (of equals: the first whose open candidate is smaller, else the last)."""
    worth = F.when(F.col("state") == "scored", F.col("score")).otherwise(F.col("upper"))
    live = candidates.filter("state != 'ineligible'").select(*ID, "state", worth.alias("worth"), (F.col("state") != "scored").alias("open"))
    first = F.struct((-F.col("worth")).alias("m"), "candidate", "open", "state")
    pairs = live.groupBy("case_id", "pair").agg(F.min(first).alias("b"), F.min(F.when(F.col("open"), first)).alias("o"))
    pairs = pairs.withColumn("loss", F.when(F.col("o").isNotNull(), F.col("o.m") - F.col("b.m")))
    low = pairs.groupBy("case_id").agg(F.min("loss").alias("low")).filter("low is not null")
    fits = pairs.join(low, "case_id").filter("loss = low")
    gives = fits.groupBy("case_id").agg(F.max(F.expr("o.candidate = b.candidate")).alias("already"), F.min(F.expr("if(o.candidate < b.candidate, pair, null)")).alias("first"), F.max("pair").alias("last"))
    gives = gives.select("case_id", F.when(~F.col("already"), F.coalesce("first", "last")).alias("way"))
    taken = F.when(F.col("pair") == F.col("way"), F.col("o")).otherwise(F.col("b"))
    return pairs.join(gives, "case_id").select("case_id", "pair", taken.alias("t")).select("case_id", "pair", "t.candidate", "t.open", (-F.col("t.m")).alias("worth"), "t.state")


def frontier(candidates: DataFrame, occupancy: DataFrame, margin: int = 0, tolerance: int = OVERLAP_MS, batch: int = BATCH, states: int = STATES, expansions: int = EXPANSIONS) -> tuple[DataFrame, DataFrame]:
    """Cases and choices.

    cases, one row a case: best_total and runner_total (null without a runner-up), bound (of assignments with an open
    candidate; null without one), deferred, state. ``exhausted``: a component's search met its bounds. ``noEligible``: all
    candidates are ineligible. ``resolved``: the best assignment is not empty and beats runner-up and bound by more than the
    margin. ``pending``: it does not, and there is a batch. ``unresolved``: it does not, and nothing can be scored.

    choices (case_id, role, pair, candidate): of role ``best``, ``runnerUp``, ``optimistic``, and ``batch``, the unresolved
    candidates of the optimistic assignment with the highest bounds, ``batch`` at most; deferred counts the others. Null
    ids are not expected; a candidate that is not scored needs no occupancy.
    """
    parts = graph.cut(solved(candidates, occupancy, tolerance, states, expansions))
    heads = parts.groupBy("case_id", "component").agg(*[F.max(F.when(F.col("rank") == r, F.col("total"))).alias(f"t{r}") for r in (1, 2)], F.max("exhausted").alias("exhausted"), F.max("at").alias("at"), F.max("smaller").alias("smaller"))
    totals = heads.groupBy("case_id").agg(
        F.sum("t1").alias("best_total"), F.max("exhausted").alias("exhausted"),
        # The runner-up leaves the best assignment in the component where that costs least; among equals by the order of lists.
        F.min(F.when(F.col("t2").isNotNull(), F.struct((F.col("t1") - F.col("t2")).alias("loss"), (~F.col("smaller")).alias("later"), F.when(F.col("smaller"), F.col("at")).otherwise(-F.col("at")).alias("at"), F.col("component")))).alias("leaves"),
    )
    hope = graph.cut(optimistic(candidates))
    by_bound = Window.partitionBy("case_id").orderBy(F.desc("worth"), "pair", "candidate")
    next_up = hope.filter("state = 'unresolved'").withColumn("n", F.row_number().over(by_bound))
    bounds = hope.groupBy("case_id").agg(F.sum("worth").alias("bound"), F.count(F.when(F.col("state") == "unresolved", 1)).alias("waiting"))
    best, runner = F.coalesce("best_total", F.lit(0)), F.col("best_total") - F.col("leaves.loss")
    every = candidates.groupBy("case_id").agg(F.max(F.col("state") != "ineligible").alias("any"))
    cases = every.join(totals, "case_id", "left").join(bounds, "case_id", "left")
    chosen = parts.filter("rank = 1 and candidate is not null").select("case_id").distinct().withColumn("some", F.lit(True))
    beats = (runner.isNull() | (best > runner + margin)) & (F.col("bound").isNull() | (best > F.col("bound") + margin))
    state = (
        F.when(F.coalesce("exhausted", F.lit(False)), "exhausted").when(~F.col("any"), "noEligible").when(beats & F.coalesce("some", F.lit(False)), "resolved").when(F.coalesce("waiting", F.lit(0)) > 0, "pending").otherwise("unresolved")
    )
    open_states = F.col("state").isin("pending", "unresolved")
    cases = cases.join(chosen, "case_id", "left").select("case_id", best.alias("best_total"), runner.alias("runner_total"), "bound", state.alias("state"), "waiting", "leaves")
    cases = graph.cut(cases.withColumn("deferred", F.when(open_states, F.greatest(F.lit(0), F.coalesce("waiting", F.lit(0)) - batch)).otherwise(0).cast("long")))
    role = lambda df, name: df.select("case_id", F.lit(name).alias("role"), "pair", "candidate")
    left = cases.filter("leaves is not null").select("case_id", F.col("leaves.component").alias("leaves"))
    by_rank = parts.join(left, "case_id").filter("candidate is not null and rank = if(component = leaves, 2, 1)")
    choices = role(parts.filter("rank = 1 and candidate is not null"), "best").unionByName(role(by_rank, "runnerUp")).unionByName(role(hope, "optimistic"))
    choices = choices.unionByName(role(next_up.filter(F.col("n") <= batch).join(cases.filter("state = 'pending'").select("case_id"), "case_id"), "batch"))
    return cases.select("case_id", "best_total", "runner_total", "bound", "deferred", "state"), choices


def refine(candidates: DataFrame, occupancy: DataFrame, score: Callable[[DataFrame], DataFrame], **limits: int) -> tuple[DataFrame, DataFrame]:
    """Cases as ``frontier`` leaves them when no case is pending any more, with the round in which each was decided, and the
    candidates with all that was scored for it. ``score`` gets a batch (case_id, pair, candidate) of all pending cases and
    returns the same rows with state and score; what it leaves out or unresolved counts as blocked, so rounds end."""
    now, done, k = graph.cut(candidates), None, 0
    settled = None
    while True:
        cases, choices = frontier(now, occupancy, **limits)
        k += 1
        decided = cases.filter("state != 'pending'").withColumn("round", F.lit(k))
        done = decided if done is None else done.unionByName(decided)
        open_cases = cases.filter("state = 'pending'").select("case_id")
        closed = now.join(open_cases, "case_id", "left_anti")
        settled = closed if settled is None else settled.unionByName(closed)
        if not open_cases.head(1):
            return done, settled
        batch = graph.cut(choices.filter("role = 'batch'").select(*ID))
        new = batch.join(score(batch).select(*ID, F.col("state").alias("_state"), F.col("score").alias("_score")), ID, "left").withColumn("_state", F.when(F.col("_state") == "unresolved", "blocked").otherwise(F.coalesce("_state", F.lit("blocked"))))
        now = now.join(open_cases, "case_id").join(new, ID, "left")
        now = graph.cut(now.withColumn("score", F.when(F.col("_state").isNull(), F.col("score")).otherwise(F.col("_score"))).withColumn("state", F.coalesce("_state", "state")).drop("_state", "_score"))


def faults(candidates: DataFrame, occupancy: DataFrame) -> DataFrame:
    """(case_id, pair, candidate, fault) for what the frontier cannot take: ``duplicate``, ``scoreAboveBound``, ``outOfRange``
    (a score or bound outside 0 to 1,000,000), ``noOccupancy`` (scored without both axes), ``emptyInterval``, ``notCanonical``
    (an interval that touches or overlaps the one before), ``severalSpaces``, ``invalidReuse``."""
    axes = occupancy.groupBy(*ID).agg(F.countDistinct("axis").alias("axes"))
    twice = candidates.groupBy(*ID).count().filter("count > 1").select(*ID, F.lit("duplicate").alias("fault"))
    of = candidates.join(axes, ID, "left")
    wrong = F.array_compact(
        F.array(
            F.when((F.col("state") == "scored") & (F.col("score") > F.col("upper")), "scoreAboveBound"),
            F.when(~F.col("upper").between(0, 1_000_000) | ((F.col("state") == "scored") & ~F.coalesce(F.col("score").between(0, 1_000_000), F.lit(False))), "outOfRange"),
            F.when((F.col("state") == "scored") & (F.coalesce("axes", F.lit(0)) < 2), "noOccupancy"),
        )
    )
    w = Window.partitionBy(*ID, "axis").orderBy("start_ms", "end_ms")
    spans = occupancy.withColumn("_before", F.lag("end_ms").over(w)).withColumn("_space", F.lag("space").over(w))
    bad = F.array_compact(
        F.array(
            F.when(F.col("start_ms") >= F.col("end_ms"), "emptyInterval"),
            F.when(F.col("_before") >= F.col("start_ms"), "notCanonical"),
            F.when(F.col("_space") != F.col("space"), "severalSpaces"),
            F.when(F.col("reuse") == 0, "invalidReuse"),
        )
    )
    return twice.unionByName(of.select(*ID, F.explode(wrong).alias("fault"))).unionByName(spans.select(*ID, F.explode(bad).alias("fault"))).distinct()
