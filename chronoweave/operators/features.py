"""Feature extraction from samples: spectra, fine frames, correlation, region means, bounded samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the feature definition.
BINS, LOW_HZ, HIGH_HZ, BANDS = 48, 80.0, 3_600.0, 12
FULL = 32_767.0


def spectrum(frames: np.ndarray, rate: int) -> np.ndarray:
    """Magnitudes at 48 log-spaced frequencies of Hann-windowed frames (rows), halved in rate from 8 kHz on."""
    step = 2 if rate >= 8_000 else 1
    x = frames[:, ::step].astype(float) / FULL
    n = x.shape[1]
    size = 1 << max(3, (n - 1).bit_length())
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / max(1, n - 1))
    f = np.abs(np.fft.rfft(x * window, size))
    hz = LOW_HZ * (min(HIGH_HZ, rate / step * 0.45) / LOW_HZ) ** (np.arange(BINS) / (BINS - 1))
    return f[:, np.minimum(np.floor(hz * size / (rate / step) + 0.5).astype(int), size // 2)]


def fine_features(frames: np.ndarray, rate: int) -> np.ndarray:
    """Per frame: log loudness, zero crossings, 12 log band energies; length 1."""
    rms = np.sqrt(np.mean((frames / FULL) ** 2, axis=1))
    loud = np.clip(np.log10(rms + 1e-6) + 6, 0, 6) / 6
    signs = frames >= 0
    crossings = (signs[:, 1:] != signs[:, :-1]).sum(axis=1) / max(1, frames.shape[1])
    edges = np.arange(BANDS + 1) * BINS // BANDS
    bands = np.log1p(np.add.reduceat(spectrum(frames, rate), edges[:-1], axis=1))
    v = np.column_stack([loud, crossings, bands])
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.where(norm > 1e-12, v / np.where(norm > 1e-12, norm, 1), v)


def frame_features(frames: DataFrame, samples: str = "samples", rate: int = 16_000, into: str = "features") -> DataFrame:
    """``frames`` with their fine features; samples are arrays of one length. Arrow batches, no shuffle."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        if not len(s):
            return pd.Series([], dtype=object)
        return pd.Series(list(fine_features(np.stack(s.to_numpy()), rate)))

    return frames.withColumn(into, run(F.col(samples)))


def correlation(a: str, b: str) -> Column:
    """Normalised cross-correlation of two arrays: -1 for other lengths or none, 0 where one does not vary."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda p, q: p + q)
    centred = lambda c: F.transform(F.col(c), lambda x: x.cast("double") - total(F.transform(F.col(c), lambda y: y.cast("double"))) / F.size(c))
    pair = F.struct(centred(a).alias("u"), centred(b).alias("v"))

    def found(p: Column) -> Column:
        dot = lambda x, y: total(F.zip_with(x, y, lambda s, t: s * t))
        d = F.sqrt(dot(p["u"], p["u"]) * dot(p["v"], p["v"]))
        return F.when(d <= 2.3e-16, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(p["u"], p["v"]) / d)))

    usable = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(usable, F.get(F.transform(F.array(pair), found), F.lit(0))).otherwise(-1.0)


def region_means(pixels: DataFrame, key: list[str], x: str, y: str, value: str, width: int = 32, height: int = 18, skip_top: int = 2, skip_bottom: int = 4) -> DataFrame:
    """Mean of a 4 by 2 grid of regions of each frame, without the rows where marks and subtitles stand."""
    rows = height - skip_top - skip_bottom
    inside = pixels.filter((F.col(y) >= skip_top) & (F.col(y) < height - skip_bottom))
    region = F.floor((F.col(y) - skip_top) * 2 / rows) * 4 + F.floor(F.col(x) * 4 / width)
    return inside.groupBy(*key, region.alias("region")).agg(F.avg(value).alias("mean"))


def priority(family: np.ndarray, ordinal: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers that mix a family with a place in it (the public SplitMix64 finish)."""
    with np.errstate(over="ignore"):
        o = ordinal.astype(np.uint64)
        v = family.astype(np.uint64) ^ (o << np.uint64(17) | o >> np.uint64(47))
        v = v + np.uint64(0x9E3779B97F4A7C15)
        v = (v ^ v >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        v = (v ^ v >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return v ^ v >> np.uint64(31)


def bounded_sample(landmarks: DataFrame, key: list[str], most: int) -> DataFrame:
    """Of each family (hash >> 8) the ``most`` landmarks whose place in the family mixes to the least number. The
    place is the rank by time, so two encodings of one medium keep corresponding landmarks."""
    w = Window.partitionBy(*key, "family").orderBy("time_ms", "hash")
    placed = landmarks.withColumn("family", F.shiftright("hash", 8)).withColumn("ordinal", F.row_number().over(w) - 1)

    @F.pandas_udf("decimal(20,0)")
    def mixed(family: pd.Series, ordinal: pd.Series) -> pd.Series:
        from decimal import Decimal

        v = priority(family.to_numpy(), ordinal.to_numpy())
        return pd.Series([Decimal(int(x)) for x in v])

    ranked = placed.withColumn("_m", mixed("family", "ordinal")).withColumn("_r", F.row_number().over(Window.partitionBy(*key, "family").orderBy("_m", "ordinal")))
    return ranked.filter(F.col("_r") <= most).drop("_m", "_r")
