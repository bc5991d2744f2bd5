"""Sequence alignment beyond joins: dense matching, monotone sparse matching. One pair is one group."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sums at the starts of stretches, and cells of a stretch, that are in memory at once.
CELLS = 8_000_000
# Columns to either side of the diagonals through both corners that are looked at first.
BESIDE = 256


def dense_matches(distance: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Monotone pairs (complete, source) with the highest sum of 1 - distance / threshold; of equal ways a match
    comes first, then skipping a complete frame. Rows are complete frames."""
    return [(i, j) for i, j, _ in traced(lambda a, z, b, y: distance[a:z, b:y], *distance.shape, threshold)]


def traced(rows: Callable[[int, int, int, int], np.ndarray], n: int, m: int, threshold: float) -> list[tuple[int, int, float]]:
    """``dense_matches`` with distances, which ``rows`` (from, to, first column, last) gives for a block.

    A way that leaves the diagonals between both corners by k columns makes at most min(n, m) - k matches, each of a gain of 1 at
    most. So where the best way within a band gains more than any that leaves it could, it is the best of all; otherwise the band
    grows, to the whole table if need be."""
    beside = BESIDE
    while True:
        band = _Band(rows, n, m, threshold, min(0, m - n) - beside, max(0, m - n) + beside)
        starts, total = band.starts(0, n, (0, np.zeros(1)), m)
        if beside >= min(n, m) or total[1][-1] > min(n, m) - beside - 1 + 1e-6:
            band.back(starts, n, m)
            return band.out[::-1]
        beside *= 4


class _Band:
    """Best sums of the columns from i + low to i + high of each row i. Of all rows only the sums at the starts of a few parts are
    kept; on the way back each part is cut into parts again, until the ways of one stretch fit in memory."""

    def __init__(self, rows: Callable[[int, int, int, int], np.ndarray], n: int, m: int, threshold: float, low: int, high: int) -> None:
        self.rows, self.threshold, self.low, self.high = rows, threshold, low, high
        width = min(m, high - low) + 1
        self.step = max(1, min(n, CELLS // 2 // width, int(n**0.5) + 1))
        self.parts = max(2, CELLS // width)
        self.out: list[tuple[int, int, float]] = []

    def swept(self, first: int, last: int, state: tuple[int, np.ndarray], upto: int, ways: bool = False) -> tuple:
        """The sums (first column, values) after a stretch of rows, from those before it; with ways and distances if asked."""
        at, best = state
        a, z = max(0, first + self.low), min(upto, last + self.high)
        best = best[a - at : z - at + 1]
        # Beyond the band sums are at least those at its end.
        best = np.append(best, np.full(z - a + 1 - len(best), best[-1]))
        d = self.rows(first, last, a, z)
        way = np.zeros(d.shape if ways else (0, 0), np.int8)
        for i, gain in enumerate(np.where(d <= self.threshold, 1 - d / self.threshold, -np.inf)):
            hit = best[:-1] + gain
            now = np.append(best[0], np.maximum.accumulate(np.maximum(hit, best[1:])))
            if ways:
                way[i] = np.where((hit >= best[1:]) & (hit >= now[:-1]), 1, np.where(best[1:] >= now[:-1], 2, 3))
            best = now
        return (a, best), way, d

    def starts(self, first: int, last: int, state: tuple[int, np.ndarray], upto: int) -> tuple[list[tuple], tuple[int, np.ndarray]]:
        """(first row, sums) of each part of some rows, and the sums after them."""
        stretches = -(-(last - first) // self.step)
        size = self.step * max(1, -(-stretches // self.parts))
        found = []
        for k in range(first, last, self.step):
            if (k - first) % size == 0:
                found.append((k, state))
            state = self.swept(k, min(last, k + self.step), state, upto)[0]
        return found, state

    def back(self, starts: list[tuple], last: int, j: int) -> int:
        """Follow the best way from column j after row ``last`` to the first start, whose column is returned."""
        while starts:
            first, state = starts.pop()
            if last - first > self.step:
                j = self.back(self.starts(first, last, state, j)[0], last, j)
            else:
                (a, _), way, d = self.swept(first, last, state, j, True)
                i = last - first
                while i and j > a:
                    w = way[i - 1, j - 1 - a]
                    i, j = i - (w != 3), j - (w != 2)
                    if w == 1:
                        self.out.append((first + i, j, float(d[i, j - a])))
            last = first
        return j


def _in_time(t: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames in order of time; those of one time in order of their values, so that no order of rows matters."""
    order = np.argsort(t, kind="stable")
    if (t[order][1:] == t[order][:-1]).any():
        order = np.lexsort((*x.T[::-1], t))
    return t[order], x[order]


def match_sequences(complete: DataFrame, source: DataFrame, key: str, t: str, vec: str, threshold: float = 0.35) -> DataFrame:
    """Dense matches of each pair's frames: pair, complete_ms, source_ms, distance (root mean square)."""

    def run(k: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = ["pair", "complete_ms", "source_ms", "distance"]
        if not len(a) or not len(b):
            return pd.DataFrame({n: [] for n in names})
        (ta, x), (tb, y) = (_in_time(f[t].to_numpy(), np.stack(f[vec].to_numpy()).astype(float)) for f in (a, b))
        xx, yy = (x * x).sum(1), (y * y).sum(1)

        def rows(i: int, z: int, j: int, e: int) -> np.ndarray:
            both = xx[i:z, None] + yy[None, j:e]
            d = both - 2 * x[i:z] @ y[j:e].T
            # Equal frames are at 0, whatever the rounding.
            return np.sqrt(np.where(d <= 1e-13 * both, 0, d) / x.shape[1])

        return pd.DataFrame([(k[0], int(ta[i]), int(tb[j]), d) for i, j, d in traced(rows, len(x), len(y), threshold)], columns=names)

    # Fresh columns, in case both sides come from one relation.
    known = F.col(t).isNotNull() & F.col(vec).isNotNull()
    right = source.filter(known).select(*[F.col(c).alias(c) for c in (key, t, vec)])
    return complete.filter(known).select(key, t, vec).groupBy(key).cogroup(right.groupBy(key)).applyInPandas(run, "pair long, complete_ms long, source_ms long, distance double")


def cuts(matches: DataFrame, least: int = 1_000) -> DataFrame:
    """Places where the complete sequence runs ahead of the source by ``least`` or more between two matches: the
    middle of the source gap, how much, and a confidence from both distances."""
    from pyspark.sql import Window

    w = Window.partitionBy("pair").orderBy("source_ms", "complete_ms")
    ahead = F.col("complete_ms") - F.col("source_ms")
    d = matches.withColumn("gap_ms", ahead - F.lag(ahead).over(w)).withColumn("_p", F.lag("source_ms").over(w))
    return d.filter(F.col("gap_ms") >= least).select("pair", (F.col("_p") + F.floor((F.col("source_ms") - F.col("_p")) / 2 + 0.5)).alias("source_at_ms"), "gap_ms")


def monotone(candidates: pd.DataFrame, votes: dict[int, int], threshold: float, bucket: int = 1_000) -> pd.DataFrame:
    """Per source frame at most one candidate, complete frames and offsets never going back (an offset by less than a
    bucket may): the best by votes, distance and nearness to the offset before."""
    out, last, before = [], -1, -np.inf
    for _, g in candidates[candidates.offset_bucket.isin(list(votes))].groupby("source_index", sort=True):
        g = g[(g.complete_index > last) & (g.offset_ms + bucket >= before)]
        if not len(g):
            continue
        away = np.abs(g.offset_ms - before) / bucket if np.isfinite(before) else 0
        score = g.offset_bucket.map(votes) * 3 + 1 - g.distance / max(threshold, 1e-6) - away
        row = g.assign(_s=score).sort_values(["_s", "complete_index"], ascending=[False, True]).iloc[0]
        out.append(row)
        last, before = row.complete_index, max(before, row.offset_ms)
    return pd.DataFrame(out, columns=candidates.columns)


def sparse_matches(candidates: DataFrame, key: str, threshold: float = 0.35, bucket: int = 1_000, top: int = 24, sure: int = 8) -> DataFrame:
    """``monotone`` for each pair, with the votes of its offset buckets. candidates: key, source_index,
    complete_index, offset_ms, distance."""

    names = list(candidates.columns)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(offset_bucket=((pdf.offset_ms / bucket + 0.5) // 1).astype(int))
        n = pdf.offset_bucket.value_counts()
        best = sorted(n.items(), key=lambda x: (-x[1], x[0]))[:top]
        votes = {k: int(v) for i, (k, v) in enumerate(best) if v >= 2 or i < sure}
        return monotone(pdf, votes, threshold, bucket)[names]

    return candidates.groupBy(key).applyInPandas(run, candidates.schema)
