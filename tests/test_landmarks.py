"""Landmarks from streams against landmarks from frames, and the bounded index over restarts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import features
from chronoweave.streaming import landmarks as L

STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture(scope="module")
def rocks(spark):
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(STORE)


def sound(seed, seconds=4.0):
    g = np.random.default_rng(seed)
    t = np.arange(int(L.RATE * seconds)) / L.RATE
    x = sum(np.sin(2 * np.pi * f * t) * (np.sin(2 * np.pi * r * t + p) > 0.3) for f, r, p in zip(g.uniform(120, 3000, 9), g.uniform(1, 6, 9), g.uniform(0, 6, 9)))
    x[: L.RATE // 4] = 0
    return np.clip(x * 3000 + g.normal(0, 200, len(t)), -32768, 32767).astype(np.int16)


def frames(spark, sounds):
    size, hop = L.WINDOW_MS * L.RATE // 1000, L.HOP_MS * L.RATE // 1000
    rows = [(m, k, x[k * hop : k * hop + size].tolist()) for m, x in sounds.items() for k in range((len(x) - size) // hop + 1)]
    return spark.createDataFrame(rows, "media string, frame long, samples array<short>")


def whole(x):
    rec = L.Recording()
    return rec.push(x) + rec.finish()


def test_any_chunking_gives_what_frames_give(spark):
    sounds = {"a": sound(1), "b": sound(2), "short": sound(3, 0.03)}
    got = {}
    for r in L.landmarks(frames(spark, sounds)).orderBy("place").collect():
        got.setdefault((r["media"], r["hash"] >> 8), []).append((r["hash"], r["time_ms"], r["strength"]))
    r = random.Random(5)
    for m, x in sounds.items():
        one = whole(x)
        assert (len(one) > 200) == (m != "short")
        for _ in range(4):
            rec, out, at = L.Recording(), [], 0
            while at < len(x):
                step = r.choice([1, 7, 399, 400, 401, 5_000, 30_000])
                out += rec.push(x[at : at + step])
                rec = L.Recording(L.RATE, *rec.state())  # as it is carried
                assert len(rec.tail) < 640 and len(rec.anchors) <= 42
                at += step
            assert out + rec.finish() == one
        by_family = {}
        for code, t, s in one:
            by_family.setdefault((m, code >> 8), []).append((code, t, s))
        assert by_family == {k: v for k, v in got.items() if k[0] == m}


def run(spark, stream, folder, name):
    q = stream.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_stream_of_chunks_over_a_restart(rocks, tmp_path):
    sounds = {"a": sound(1, 2.0), "b": sound(2, 2.0)}
    rows = [(m, k, x[k * 9_000 : (k + 1) * 9_000].tolist(), (k + 1) * 9_000 >= len(x)) for m, x in sounds.items() for k in range(-(-len(x) // 9_000))]
    chunk = "media string, seq long, samples array<short>, last boolean"
    first, later = rows[2:3] + rows[:1] + rows[4:6], rows[:2] + rows[3:4] + rows[6:]  # one early, one repeated
    for k, part in enumerate((first, later)):
        rocks.createDataFrame(part, chunk).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run(rocks, L.stream_landmarks(rocks.readStream.schema(chunk).parquet(f"{tmp_path}/in")), tmp_path, "out")
    got = sorted((r["media"], r["hash"], r["time_ms"], r["strength"]) for r in rocks.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted((m, *x) for m, s in sounds.items() for x in whole(s))


def test_index_equals_the_batch_sample_over_a_restart(rocks, tmp_path):
    r = random.Random(7)
    rows = sorted((r.choice("ab"), (r.randrange(6) << 8) | r.randrange(20), t) for t in range(400))
    rows.sort(key=lambda x: x[2])
    schema = "media string, hash long, time_ms long"
    for part in (rows[:150], rows[150:160], rows[160:]):
        rocks.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = L.stream_index(rocks.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), most=9)
        q = stream.writeStream.outputMode("update").foreachBatch(lambda df, k: df.write.mode("append").parquet(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    want = features.bounded_sample(rocks.createDataFrame(rows, schema), ["media"], 9)
    cols = ("media", "family", "ordinal", "hash", "time_ms")
    pick = lambda df: sorted(tuple(x[c] for c in cols) for x in df.collect())
    index = L.latest(rocks.read.parquet(f"{tmp_path}/out"))
    assert pick(index) == pick(want) and index.agg(F.max("seen")).first()[0] < 60
