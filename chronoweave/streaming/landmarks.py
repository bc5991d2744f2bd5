"""Landmarks of sound, from whole recordings and from streams of samples, and an index of them with a bound for each family.

A landmark is a pair of spectral peaks: two bins and the time between them. From frames, peaks and pairs are joins: a peak is
paired with the first ``fanout`` later ones within a second, whatever else happens. From a stream, samples come in chunks of
any length, and the state of a recording has a bound: less than a window of samples, two spectra, and the peaks of a second.
Both ways give the same rows, however a stream is cut.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.features import BINS, FULL, priority, spectrum

# Fixed values of the landmark definition.
RATE, WINDOW_MS, HOP_MS, SILENCE, LEAST_RATIO, PEAKS, FANOUT, LEAST_MS, MOST_MS, STEP_MS, MOST_HASHES = 16_000, 40, 25, 0.008, 2.25, 4, 5, 75, 1_000, 50, 48
LANDMARK = "hash long, time_ms long, strength long"


def frame_time(frame: int, rate: int = RATE) -> int:
    """The time of a frame's middle sample, rounded."""
    middle = frame * (HOP_MS * rate // 1000) + WINDOW_MS * rate // 1000 // 2
    return (2 * middle * 1000 + rate) // (2 * rate)


def spectra(samples: np.ndarray, rate: int = RATE) -> tuple[np.ndarray, np.ndarray]:
    """Spectra of frames (rows of samples), and whether each is loud enough."""
    rms = np.sqrt(np.mean((samples / FULL) ** 2, axis=1))
    return np.round(spectrum(samples, rate), 9), rms >= SILENCE


def peaks(now: np.ndarray, before: np.ndarray | None, after: np.ndarray | None) -> list[tuple[int, float]]:
    """(bin, magnitude) of a spectrum's peaks among its neighbours in frequency and time, strongest first; of a plateau in
    frequency the lowest bin, in time the last frame."""
    zero = np.zeros(BINS)
    b, a = (zero if x is None else x for x in (before, after))
    mid = now[1:-1]
    hit = (mid > now[:-2]) & (mid >= now[2:]) & (mid >= b[1:-1]) & (mid > a[1:-1]) & (mid >= now.mean() * LEAST_RATIO)
    found = [(int(k) + 1, float(mid[k])) for k in np.flatnonzero(hit)]
    return sorted(found, key=lambda p: (-p[1], p[0]))[:PEAKS]


def landmark(anchor: tuple[int, float], target: tuple[int, float], delta_ms: int) -> tuple[int, int]:
    """(hash, strength) of a pair of peaks."""
    step = min(255, max(0, (delta_ms + STEP_MS // 2) // STEP_MS))
    return anchor[0] << 16 | target[0] << 8 | step, int(np.floor(np.log(min(anchor[1], target[1]) + 1) * 1000 + 0.5))


def landmarks(frames: DataFrame, rate: int = RATE) -> DataFrame:
    """(media, hash, time_ms, strength, place) from frames (media, frame, samples: one window each, a hop apart). place is the
    landmark's number within its recording and family, in the order in which a stream gives them."""

    @F.pandas_udf("struct<v: array<double>, active: boolean>")
    def spectral(samples: pd.Series) -> pd.DataFrame:
        if not len(samples):
            return pd.DataFrame({"v": [], "active": []})
        v, active = spectra(np.stack(samples.to_numpy()).astype(float), rate)
        return pd.DataFrame({"v": list(v), "active": active})

    @F.pandas_udf("array<struct<bin: int, magnitude: double>>")
    def found(now: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series([[{"bin": b, "magnitude": m} for b, m in peaks(np.asarray(x), p if p is None else np.asarray(p), n if n is None else np.asarray(n))] for x, p, n in zip(now, before, after)], dtype=object)

    s = frames.select("media", "frame", spectral("samples").alias("s")).select("media", "frame", "s.v", "s.active")
    near = lambda by, name: s.select("media", (F.col("frame") + by).alias("frame"), F.col("v").alias(name))
    around = s.filter("active").join(near(1, "before"), ["media", "frame"], "left").join(near(-1, "after"), ["media", "frame"], "left")
    half, hop = WINDOW_MS * rate // 1000 // 2, HOP_MS * rate // 1000
    time = F.floor(((F.col("frame") * hop + half) * 2000 + rate) / (2 * rate)).cast("long")
    p = around.select("media", "frame", time.alias("t"), F.posexplode(found("v", "before", "after")).alias("rank", "p")).select("media", "frame", "t", "rank", "p.bin", "p.magnitude")
    a, b = (p.select("media", *[F.col(c).alias(f"{side}_{c}") for c in ("frame", "t", "rank", "bin", "magnitude")]) for side in "ab")
    a = a.withColumn("_bin", F.explode(F.array(*[F.floor(F.col("a_t") / MOST_MS) + k for k in (0, 1)])))
    delta = F.col("b_t") - F.col("a_t")
    pairs = a.join(b.withColumn("_bin", F.floor(F.col("b_t") / MOST_MS)), ["media", "_bin"]).filter(delta.between(LEAST_MS, MOST_MS))
    first = Window.partitionBy("media", "a_frame", "a_rank").orderBy("b_frame", "b_rank")
    pairs = pairs.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= FANOUT)
    step = F.least(F.lit(255), F.floor((delta + STEP_MS // 2) / STEP_MS)).cast("int")
    code = F.shiftleft(F.col("a_bin").cast("long"), 16).bitwiseOR(F.shiftleft(F.col("b_bin").cast("long"), 8)).bitwiseOR(step.cast("long"))
    strength = F.floor(F.log(F.least("a_magnitude", "b_magnitude") + 1) * 1000 + 0.5).cast("long")
    order = Window.partitionBy("media", F.shiftright(code, 8)).orderBy("b_frame", "a_frame", "a_rank", "b_rank")
    return pairs.select("media", code.alias("hash"), F.col("a_t").alias("time_ms"), strength.alias("strength"), (F.row_number().over(order) - 1).cast("long").alias("place"))


class Recording:
    """What is carried of a recording between chunks."""

    def __init__(self, rate: int = RATE, tail: bytes = b"", frame: int = 0, before: bytes = b"", now: bytes = b"", active: bool = False, anchors: str = "[]"):
        self.rate, self.tail, self.frame, self.active = rate, np.frombuffer(tail, np.int16), frame, active
        self.before, self.now = (np.frombuffer(x) if x else None for x in (before, now))
        #: [time, [[bin, magnitude, pairs given]]] of the frames of the last second
        self.anchors = json.loads(anchors)

    def state(self) -> tuple:
        return self.tail.tobytes(), self.frame, *(b"" if x is None else x.tobytes() for x in (self.before, self.now)), self.active, json.dumps(self.anchors)

    def push(self, samples: np.ndarray) -> list[tuple[int, int, int]]:
        """Landmarks (hash, time_ms, strength) that the samples complete."""
        size, hop = WINDOW_MS * self.rate // 1000, HOP_MS * self.rate // 1000
        data = np.concatenate([self.tail, samples.astype(np.int16)])
        n = max(0, (len(data) - size) // hop + 1)
        out: list[tuple[int, int, int]] = []
        for k in range(0, n, 256):
            v, active = spectra(np.lib.stride_tricks.sliding_window_view(data, size)[k * hop : min(n, k + 256) * hop : hop].astype(float), self.rate)
            for x, loud in zip(v, active):
                out += self._settle(x)
                self.before, self.now, self.active = self.now, x, bool(loud)
                self.frame += 1
        self.tail = data[n * hop :]
        return out

    def finish(self) -> list[tuple[int, int, int]]:
        """Landmarks that the last frame completes."""
        return self._settle(None)

    def _settle(self, after: np.ndarray | None) -> list[tuple[int, int, int]]:
        """The last frame's peaks are known once the next spectrum is."""
        if self.now is None:
            return []
        t = frame_time(self.frame - 1, self.rate)
        found = peaks(self.now, self.before, after) if self.active else []
        out = []
        for at, anchors in self.anchors:
            if LEAST_MS <= t - at <= MOST_MS:
                for anchor in anchors:
                    for p in found[: FANOUT - anchor[2]]:
                        code, strength = landmark((anchor[0], anchor[1]), p, t - at)
                        out.append((code, at, strength))
                        anchor[2] += 1
        self.anchors = [[at, anchors] for at, anchors in self.anchors if t - at < MOST_MS and any(a[2] < FANOUT for a in anchors)]
        if found:
            self.anchors.append([t, [[b, m, 0] for b, m in found]])
        return out


class _Extractor(StatefulProcessor):
    def __init__(self, rate: int):
        self.rate = rate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("recording", "tail binary, frame long, before binary, now binary, active boolean, anchors string, next long")
        self.early = handle.getMapState("early", "seq long", "samples array<short>, last boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        state = tuple(self.held.get()) if self.held.exists() else None
        rec, due = (Recording(self.rate, *(bytes(x) if isinstance(x, (bytes, bytearray)) else x for x in state[:-1])), state[-1]) if state else (Recording(self.rate), 0)
        for pdf in rows:
            for seq, samples, last in zip(pdf.seq, pdf.samples, pdf["last"]):
                if seq >= due:
                    self.early.updateValue((int(seq),), ([int(x) for x in samples], bool(last)))
        out: list[tuple[int, int, int]] = []
        while self.early.containsKey((due,)):
            samples, last = self.early.getValue((due,))
            self.early.removeKey((due,))
            out += rec.push(np.asarray(samples, np.int16))
            due += 1
            if last:
                out += rec.finish()
                rec = Recording(self.rate)
        self.held.update((*rec.state(), due))
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["media", "hash", "time_ms", "strength"])

    def close(self) -> None:
        pass


def stream_landmarks(chunks: DataFrame, rate: int = RATE) -> DataFrame:
    """(media, hash, time_ms, strength) from a stream of chunks (media, seq from 0, samples: array of short, last). Chunks
    that come before their predecessors wait in the state; repeated ones are left out. Needs the RocksDB state store."""
    return chunks.select("media", "seq", "samples", "last").groupBy("media").transformWithStateInPandas(_Extractor(rate), f"media string, {LANDMARK}", "append", "None")


class _Index(StatefulProcessor):
    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "seen long, place array<long>, hash array<long>, time_ms array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        seen, *old = self.kept.get() if self.kept.exists() else (0, [], [], [])
        new = pd.concat(list(rows)).sort_values(["time_ms", "hash"], kind="stable")
        places = np.concatenate([np.asarray(old[0], np.int64), seen + np.arange(len(new))])
        codes, times = (np.concatenate([np.asarray(o, np.int64), new[c].to_numpy(np.int64)]) for o, c in ((old[1], "hash"), (old[2], "time_ms")))
        # The least of the mixed numbers stay; they depend on the place in the family alone.
        stay = np.lexsort((places, priority(np.full(len(places), key[1], np.uint64), places.astype(np.uint64))))[: self.most]
        stay = stay[np.argsort(places[stay])]
        seen += len(new)
        self.kept.update((seen, places[stay].tolist(), codes[stay].tolist(), times[stay].tolist()))
        yield pd.DataFrame({"media": key[0], "family": int(key[1]), "seen": seen, "ordinal": places[stay], "hash": codes[stay], "time_ms": times[stay]})

    def close(self) -> None:
        pass


def stream_index(found: DataFrame, most: int = MOST_HASHES) -> DataFrame:
    """Of each recording's family (hash >> 8) the ``most`` landmarks that ``features.bounded_sample`` keeps, from a stream of
    landmarks (media, hash, time_ms) in which none is older than one of an earlier batch. Each batch gives a changed family's
    rows anew; those with the highest ``seen`` are the family's (``latest``). Needs the RocksDB state store."""
    keyed = found.select("media", F.shiftright("hash", 8).alias("family"), "hash", "time_ms")
    return keyed.groupBy("media", "family").transformWithStateInPandas(_Index(most), "media string, family long, seen long, ordinal long, hash long, time_ms long", "update", "None")


def latest(index: DataFrame) -> DataFrame:
    """The last state of every family in a table of what ``stream_index`` gave."""
    newest = index.groupBy("media", "family").agg(F.max("seen").alias("seen"))
    return index.join(newest, ["media", "family", "seen"])
