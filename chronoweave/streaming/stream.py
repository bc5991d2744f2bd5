"""Streaming forms of the windowed operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def density(events: DataFrame, ts: str, width: str = "1 hour", late: str = "10 minutes", key: list[str] | None = None) -> DataFrame:
    """Events per tumbling window of event time (watermark ``late``); works on a batch as well."""
    keyed = events.withWatermark(ts, late) if events.isStreaming else events
    return keyed.groupBy(F.window(ts, width), *(key or [])).agg(F.count("*").alias("n_events")).select(F.col("window.start").alias("window_start"), *(key or []), "n_events")


def playback(observations: DataFrame, most_gap: int = 750, rate: float = 1.35, jitter: int = 120) -> DataFrame:
    """Plausibly played milliseconds per session from (session, wall_ms, media_ms) observations, kept as state. A
    stalled observation leaves the older one in place."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        wall, media, played = state.get if state.exists else (None, None, 0)
        for pdf in frames:
            for w, m in pdf.sort_values("wall_ms")[["wall_ms", "media_ms"]].itertuples(index=False):
                if wall is not None and m == media:
                    continue
                if wall is not None and 0 < w - wall <= most_gap and 0 < m - media <= (w - wall) * rate + jitter:
                    played += int(m - media)
                wall, media = int(w), int(m)
        state.update((wall, media, played))
        yield pd.DataFrame({"session": [key[0]], "played_ms": [played]})

    return observations.groupBy("session").applyInPandasWithState(step, "session long, played_ms long", "wall long, media long, played long", "update", GroupStateTimeout.NoTimeout)


def frame_groups(frames: DataFrame, key: list[str], index: str, t: str, hop_ms: int, width_ms: int = 500) -> DataFrame:
    """Fingerprint frames: every ceil(width / hop) frames, at the middle of their span."""
    n = -(-width_ms // hop_ms)
    return frames.groupBy(*key, F.floor(F.col(index) / n).alias("group")).agg(F.min(t).alias("first_ms"), F.count("*").alias("n_frames")).withColumn("time_ms", F.col("first_ms") + F.floor((F.col("n_frames") - 1) * hop_ms / 2)).drop("first_ms")
