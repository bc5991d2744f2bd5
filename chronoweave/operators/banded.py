"""Alignment of two frame sequences that knows of cuts and insertions, in a band around a coarse line.

Three states (matched, sourceOnly, targetOnly) with affine gap costs. A row of the table has only the cells whose target
time lies within ``radius_ms`` of scale * source time + offset, so time and memory are in proportion to the source's
length times the band's width, and there is no limit on cells. Of the way taken a cell remembers one byte.

One pair of sequences is one problem, as each row needs the one before; pairs are dealt out by their key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Gap costs, the cost from which a match is doubtful, the band's radius, frames on both sides in a match's cost.
OPENING, EXTENDING, DOUBTFUL, RADIUS_MS, AROUND = 300, 60, 700, 2_000, 2
_FAR = 1 << 58
MATCHED, SOURCE, TARGET = 0, 1, 2
KINDS = ("matched", "sourceOnly", "targetOnly")


def _unit(v: np.ndarray) -> np.ndarray:
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.where(norm > 2.3e-16, v / np.where(norm > 2.3e-16, norm, 1), np.nan)


def _cost(dots: np.ndarray) -> np.ndarray:
    """Thousandths of 1 - cosine, rounded half up; 1000 where a frame has no direction."""
    return np.where(np.isnan(dots), 1000, np.floor(np.clip(1 - dots, 0, 2) * 1000 + 0.5)).astype(np.int64)


class Band:
    """Cells of each source frame: target frames ``low[i]`` to ``high[i]`` (half open) lie within the radius."""

    def __init__(self, source_ms: np.ndarray, target_ms: np.ndarray, scale: float, offset_ms: float, radius_ms: float):
        line = scale * source_ms.astype(float) + offset_ms
        self.low = np.searchsorted(target_ms, np.ceil(line - radius_ms), "left")
        self.high = np.searchsorted(target_ms, np.floor(line + radius_ms), "right")
        self.high = np.maximum(self.high, self.low)


def align(source: np.ndarray, target: np.ndarray, band: Band, semi_global: bool = False, opening: int = OPENING, extending: int = EXTENDING) -> tuple[int, list[tuple[int, int, int]]] | None:
    """(total cost, [(state, i, j)]): the cheapest way through all source frames, and all target frames too unless
    ``semi_global``, where those before and after the way are free. i and j are the frames that lie before a step. Of equal
    ways those with a match, then with a source frame, come first; a semi-global way ends as late as it can. None if the band
    has no way."""
    n, m = len(source), len(target)
    x, y = _unit(source), _unit(target)
    # Row 0: costs at target boundaries 0 to m by state; later rows: the band's boundaries only, and boundary 0.
    before = np.full((3, m + 1), _FAR, np.int64)
    before[MATCHED, 0] = 0
    if semi_global:
        before[MATCHED, 1:] = 0
    else:
        before[TARGET, 1:] = opening + extending * np.arange(m)
    first = 0  # boundary of before[:, 0]
    ways: list[np.ndarray] = []
    starts = np.zeros(n, np.int64)
    edge = np.array([before[:, 0]])  # of boundary 0 in the row before

    def cells(a: int, z: int) -> np.ndarray:
        """Costs of the row before at boundaries a to z (half open); far where it has none."""
        out = np.full((3, z - a), _FAR, np.int64)
        lo, hi = max(a, first), min(z, first + before.shape[1])
        if hi > lo:
            out[:, lo - a : hi - a] = before[:, lo - first : hi - first]
        if a == 0 and z > 0:
            out[:, 0] = edge[0]
        return out

    for i in range(n):
        a, z = int(band.low[i]) + 1, int(band.high[i]) + 1  # boundaries after the band's target frames
        now, way = np.full((3, z - a), _FAR, np.int64), np.zeros(z - a, np.uint8)
        zero = np.array([_FAR, opening + extending * i, _FAR])
        if z > a:
            diagonal, above = cells(a - 1, z - 1), cells(a, z)
            k0 = diagonal.argmin(axis=0)
            now[MATCHED] = np.minimum(diagonal[k0, np.arange(z - a)] + _cost(y[a - 1 : z - 1] @ x[i]), _FAR)
            up = above + np.array([[opening], [extending], [opening]])
            k1 = up.argmin(axis=0)
            now[SOURCE] = np.minimum(up[k1, np.arange(z - a)], _FAR)
            # targetOnly within the row: the cheapest start of the gap, each further frame costing the same.
            left = np.concatenate([[int(zero.min()) if a == 1 else _FAR], now[:2].min(axis=0)[:-1]])
            span = np.arange(z - a) * extending
            gap = np.minimum.accumulate(np.where(left >= _FAR, _FAR, left + opening - span)) + span
            now[TARGET] = np.minimum(gap, _FAR)
            prior = np.concatenate([zero[:, None] if a == 1 else np.full((3, 1), _FAR), now[:, :-1]], axis=1) + np.array([[opening], [opening], [extending]])
            k2 = np.minimum(prior, _FAR).argmin(axis=0)
            way = (k0 | k1 << 2 | k2 << 4).astype(np.uint8)
        ways.append(way)
        starts[i] = a
        before, first, edge = now, a, np.array([zero])

    last = cells(0, m + 1) if n else before
    ends = range(m + 1) if semi_global else (m,)
    cost, end, state = min((int(last[s, j]), -j, s) for j in ends for s in range(3))
    if cost >= _FAR:
        return None
    i, j, steps = n, -end, []
    while i or (j and not semi_global):
        if i == 0:
            parent = MATCHED if j == 1 else TARGET
        elif j == 0:
            parent = MATCHED if i == 1 else SOURCE
        else:
            parent = int(ways[i - 1][j - starts[i - 1]]) >> (2 * state) & 3
        if state != TARGET:
            i -= 1
        if state != SOURCE:
            j -= 1
        steps.append((state, i, j))
        state = parent
    return cost, steps[::-1]


def boundaries(times: np.ndarray) -> np.ndarray:
    """Frame times and the end of the last frame, which is as long as the upper median of the others."""
    hop = int(np.sort(np.diff(times))[(len(times) - 1) // 2]) if len(times) > 1 else 1
    return np.append(times, times[-1] + hop)


def spans(steps: list[tuple[int, int, int]], source: np.ndarray, target: np.ndarray, source_ms: np.ndarray, target_ms: np.ndarray, doubtful: int = DOUBTFUL, extending: int = EXTENDING) -> list[list]:
    """[kind, source start, end, target start, end, steps, cost] of the way's maximal spans. A match whose cost, averaged with
    up to AROUND frames on both sides, is ``doubtful`` or more is ambiguous; so is a stretch of gaps on both sides, as one."""
    x, y = _unit(source), _unit(target)
    n, m = len(x), len(y)
    edges, into = boundaries(source_ms), boundaries(target_ms)

    def around(i: int, j: int) -> int:
        back, on = min(AROUND, i, j), min(AROUND, n - i - 1, m - j - 1)
        c = _cost((x[i - back : i + on + 1] * y[j - back : j + on + 1]).sum(axis=1))
        return int((c.sum() + len(c) // 2) // len(c))

    out: list[list] = []

    def add(kind: str, a: int, z: int, b: int, y_: int, count: int, cost: int, joins: bool) -> None:
        if joins and out and out[-1][0] == kind and out[-1][2] == a and out[-1][4] == b:
            out[-1][2], out[-1][4] = z, y_
            out[-1][5] += count
            out[-1][6] += cost
        else:
            out.append([kind, a, z, b, y_, count, cost])

    k = 0
    while k < len(steps):
        state, i, j = steps[k]
        if state == MATCHED:
            c = around(i, j)
            add("ambiguous" if c >= doubtful else "matched", int(edges[i]), int(edges[i + 1]), int(into[j]), int(into[j + 1]), 1, c, True)
            k += 1
            continue
        e = k
        while e < len(steps) and steps[e][0] != MATCHED:
            e += 1
        run = steps[k:e]
        if len({s for s, *_ in run}) == 2:
            i2, j2 = run[-1][1] + (run[-1][0] == SOURCE), run[-1][2] + (run[-1][0] == TARGET)
            add("ambiguous", int(edges[i]), int(edges[i2]), int(into[j]), int(into[j2]), len(run), extending * len(run), True)
        else:
            for s, i1, j1 in run:
                add(KINDS[s], int(edges[i1]), int(edges[i1 + (s == SOURCE)]), int(into[j1]), int(into[j1 + (s == TARGET)]), 1, extending, True)
        k = e
    return out


_SCHEMA = "pair long, span long, kind string, source_start_ms long, source_end_ms long, target_start_ms long, target_end_ms long, n_steps long, cost long, total_cost long"


def aligned(source: DataFrame, target: DataFrame, coarse: DataFrame | None = None, semi_global: bool = False, radius_ms: int = RADIUS_MS, doubtful: int = DOUBTFUL) -> DataFrame:
    """Spans of each pair's alignment. Frames are rows (pair, time_ms, vec), of times that rise; coarse (pair, scale,
    offset_ms), identity without it. Returns pair, span, kind, source and target bounds, n_steps, cost (of the span's steps as
    ``spans`` counts them) and total_cost (of the way). A pair without frames on a side has no row; one without a way in its
    band has one row of kind ``noPath``."""
    scale, offset = ("_scale", "_offset")
    lines = coarse.select("pair", F.col("scale").alias(scale), F.col("offset_ms").alias(offset)) if coarse is not None else source.select("pair").distinct().select("pair", F.lit(1.0).alias(scale), F.lit(0.0).alias(offset))

    def run(key: tuple, s: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in _SCHEMA.split(", ")]
        if not len(s) or not len(t):
            return pd.DataFrame(columns=names)
        s, t = s.sort_values("time_ms"), t.sort_values("time_ms")
        x, y = (np.stack(f.vec.to_numpy()).astype(float) for f in (s, t))
        xm, ym = s.time_ms.to_numpy(np.int64), t.time_ms.to_numpy(np.int64)
        found = align(x, y, Band(xm, ym, float(s[scale].iloc[0]), float(s[offset].iloc[0]), radius_ms), semi_global)
        if found is None:
            return pd.DataFrame([(key[0], 0, "noPath", *[None] * 7)], columns=names).astype(object)
        rows = [(key[0], k, *r, found[0]) for k, r in enumerate(spans(found[1], x, y, xm, ym, doubtful))]
        return pd.DataFrame(rows, columns=names)

    left = source.select("pair", "time_ms", "vec").join(lines, "pair").groupBy("pair")
    right = target.select(*[F.col(c).alias(c) for c in ("pair", "time_ms", "vec")]).groupBy("pair")
    return left.cogroup(right).applyInPandas(run, _SCHEMA)
