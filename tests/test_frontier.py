"""The frontier of fine scoring against all assignments, and its rounds."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import frontier, graph

C = "case_id long, pair long, candidate long, upper long, state string, score long"
O = "case_id long, pair long, candidate long, axis string, space long, start_ms long, end_ms long, reuse long"  # noqa: E741
END = (float("inf"),)


def cases(n, seed=5, scored_all=False):
    """Random cases: candidates and occupancy; case 0 has only ineligible ones, case 1 only blocked ones."""
    r, cs, os_ = random.Random(seed), [], []
    for case in range(n):
        for pair in range(r.randint(1, 4)):
            for cand in range(r.randint(1, 3)):
                upper = r.choice([200, 300, 300, 500, 900])
                state = r.choice(["scored", "scored", "unresolved", "blocked", "ineligible"]) if case > 1 else ("ineligible", "blocked")[case]
                state = "scored" if scored_all and case > 1 else state
                score = r.choice([upper, upper - 100, upper - 150]) if state == "scored" else None
                cs.append((case, pair, cand, upper, state, score))
                for axis in ("source", "target"):
                    space, reuse, at = r.randint(0, 1), r.choice([None, None, 1, 2]), 0
                    for _ in range(r.randint(1, 2)):
                        a = at + r.randint(1, 1200)
                        at = a + r.randint(200, 1500)
                        os_.append((case, pair, cand, axis, space, a, at, reuse))
    return cs, os_


def brute(cs, os_, margin, batch):
    out = {}
    for case in {c[0] for c in cs}:
        mine = [c for c in cs if c[0] == case]
        occ = {}
        for _, p, i, axis, space, a, z, reuse in (o for o in os_ if o[0] == case):
            occ.setdefault((p, i), []).append((axis, space, a, z, reuse))

        def clash(x, y):
            return any(s[:2] == t[:2] and min(s[3], t[3]) - max(s[2], t[2]) > 250 and not (s[4] is not None and s[4] == t[4]) for s in occ[x] for t in occ[y])

        pairs = sorted({c[1] for c in mine})
        value = {(c[1], c[2]): c for c in mine}

        def assignments(keep):
            options = [[None, *[(p, c[2]) for c in mine if c[1] == p and keep(c)]] for p in pairs]
            return [tuple(x for x in choice if x) for choice in itertools.product(*options)]

        done = [a for a in assignments(lambda c: c[4] == "scored") if not any(clash(x, y) for x, y in itertools.combinations(a, 2))]
        ranked = sorted((-sum(value[x][5] for x in a), (*a, END), a) for a in done)
        hope = [a for a in assignments(lambda c: c[4] != "ineligible") if any(value[x][4] != "scored" for x in a)]
        worth = lambda x: value[x][5] if value[x][4] == "scored" else value[x][3]
        hoped = sorted((-sum(map(worth, a)), (*a, END), a) for a in hope)
        best, runner = -ranked[0][0], -ranked[1][0] if len(ranked) > 1 else None
        bound = -hoped[0][0] if hoped else None
        waiting = sorted((x for x in hoped[0][2] if value[x][4] == "unresolved"), key=lambda x: (-value[x][3], x)) if hoped else []
        if all(c[4] == "ineligible" for c in mine):
            state = "noEligible"
        elif (runner is None or best > runner + margin) and (bound is None or best > bound + margin) and ranked[0][2]:
            state = "resolved"
        else:
            state = "pending" if waiting else "unresolved"
        is_open = state in ("pending", "unresolved")
        out[case] = {
            "row": (best, runner, bound, max(0, len(waiting) - batch) if is_open else 0, state),
            "best": set(ranked[0][2]), "runnerUp": set(ranked[1][2]) if runner is not None else set(), "optimistic": set(hoped[0][2]) if hoped else set(), "batch": set(waiting[:batch]) if state == "pending" else set(),
        }
    return out


@pytest.mark.parametrize(("margin", "batch", "scored_all"), [(0, 1, False), (60, 2, False), (0, 2, True)])
def test_states_and_choices_equal_all_assignments(spark, margin, batch, scored_all):
    cs, os_ = cases(60, scored_all=scored_all)
    table, choices = frontier.frontier(spark.createDataFrame(cs, C), spark.createDataFrame(os_, O), margin=margin, batch=batch)
    want = brute(cs, os_, margin, batch)
    got = {r["case_id"]: tuple(r)[1:] for r in table.collect()}
    assert got == {k: v["row"] for k, v in want.items()}
    held = {}
    for r in choices.collect():
        held.setdefault((r["case_id"], r["role"]), set()).add((r["pair"], r["candidate"]))
    for case, w in want.items():
        for role in ("best", "runnerUp", "optimistic", "batch"):
            assert held.get((case, role), set()) == w[role], (case, role)
    states = {v["row"][-1] for v in want.values()}
    assert {"noEligible", "resolved", "unresolved"} <= states | {"resolved"} and (scored_all or "pending" in states)


def test_a_search_beyond_its_bounds_is_a_state(spark):
    cs = [(1, p, c, 500, "scored", 500 - c) for p in range(9) for c in range(3)] + [(2, 0, 0, 500, "scored", 400)]
    os_ = [(case, p, c, axis, p * 10 + c if axis == "source" else 0, 0 if case == 2 else c * 10, 1000, None) for case, p, c, *_ in cs for axis in ("source", "target")]
    table, _ = frontier.frontier(spark.createDataFrame(cs, C), spark.createDataFrame(os_, O), states=20)
    assert {r["case_id"]: r["state"] for r in table.collect()} == {1: "exhausted", 2: "resolved"}


def test_rounds_end_and_equal_scoring_everything(spark):
    cs, os_ = cases(40, seed=9)
    truth = {c[:3]: max(0, c[3] - 70 * (c[2] + 1)) for c in cs}
    known = [(*c[:4], "scored", truth[c[:3]]) if c[4] == "scored" else c for c in cs]
    scores = spark.createDataFrame([(*k, "scored", v) for k, v in truth.items()], "case_id long, pair long, candidate long, state string, score long")
    asked = []

    def score(batch):
        asked.append(batch.count())
        assert batch.groupBy("case_id").count().agg(F.max("count")).first()[0] <= 2
        return batch.join(scores, frontier.ID)

    decided, final = frontier.refine(spark.createDataFrame(known, C), spark.createDataFrame(os_, O), score, batch=2)
    rows = decided.collect()
    assert len(rows) == 40 and {r["state"] for r in rows} <= {"resolved", "unresolved", "noEligible"} and len(asked) == max(r["round"] for r in rows) - 1 > 0
    want = brute([(*c[:4], "scored", truth[c[:3]]) if c[4] == "unresolved" else c for c in known], os_, 0, 2)
    for r in rows:  # what is resolved early is what scoring everything resolves
        if r["state"] == "resolved":
            assert r["best_total"] == want[r["case_id"]]["row"][0]
    assert final.count() == len(cs)


def test_faults(spark):
    cs = [(1, 0, 0, 500, "scored", 600), (1, 0, 1, 2_000_000, "unresolved", None), (1, 1, 0, 5, "scored", 5), (1, 1, 0, 5, "scored", 5), (1, 2, 0, 5, "unresolved", None)]
    os_ = [(1, 0, 0, a, 0, 0, 10, None) for a in ("source", "target")] + [(1, 1, 0, "source", 0, 0, 10, 0), (1, 1, 0, "source", 1, 10, 10, None)]
    got = {(r["pair"], r["candidate"], r["fault"]) for r in frontier.faults(spark.createDataFrame(cs, C), spark.createDataFrame(os_, O)).collect()}
    assert got == {(0, 0, "scoreAboveBound"), (0, 1, "outOfRange"), (1, 0, "duplicate"), (1, 0, "noOccupancy"), (1, 0, "emptyInterval"), (1, 0, "notCanonical"), (1, 0, "severalSpaces"), (1, 0, "invalidReuse")}


def test_empty_inventory(spark):
    table, choices = frontier.frontier(spark.createDataFrame([], C), spark.createDataFrame([], O))
    assert table.count() == 0 and choices.count() == 0


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(k, i, i + 1) for k in (1, 2) for i in range(n) if k == 1 or i % 10], "k long, a long, b long")
    got = {(r["k"], r["node"]): r["component"] for r in graph.components(edges, "k", "a", "b").collect()}
    assert all(got[1, i] == 0 for i in range(n + 1)) and all(got[2, i] == (i - 1) // 10 * 10 + 1 for i in range(1, n + 1))
