"""Where a recording lies in another one, by blocks of spectral fingerprints.

Blocks of the target, spread over its length, are looked for at every place of the source. A block's best place and the
best one apart from it say how distinctive it is; distinctive blocks vote for offsets, and each offset that enough blocks
agree on is a hypothesis. Then blocks every minute, held out from the vote, are looked for near the place that a hypothesis
says.

The plan: a request is a target block and a range of source places. Source frames are cut into chunks of ``PLACES`` places
with the block's length to spare, requests meet the chunks they touch by an equality, and scores are made in Arrow batches,
a row being one chunk and one block. What is folded for a request are its scores, in order. Votes, residuals and hypotheses
are aggregates over the requests of a pair, whose number has a bound (``most_blocks``).

Frames are rows (pair, frame, time_ms, values, active): frame numbers go from 0 without a gap, values are band energies,
active is the share of active parts in thousandths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph, intervals

#: Source places in a chunk.
PLACES = 2048
# Fixed values of the block score, the hypothesis score, coverage, activity and the distance of held-out blocks.
ABSOLUTE, CHANGE, ACTIVITY = 0.60, 0.30, 0.10
BLOCK_SHARE, COVERAGE_SHARE, SUPPORT_SHARE, FULL_SUPPORT, LEAST_COVERAGE = 0.50, 0.30, 0.20, 16, 0.35
LEAST_ACTIVE, EVERY_MS, HELD_OUT = 100, 60_000, (5, 2)


def place_scores(sv: np.ndarray, sa: np.ndarray, tv: np.ndarray, ta: np.ndarray) -> np.ndarray:
    """Scores of a block (tv, ta: values and activity of its frames) at every place of a stretch of source frames.

    A frame counts ABSOLUTE times the cosine, CHANGE times the cosine of the changes since the frame before, moved to 0 to 1
    (the plain cosine where that one did not count), and ACTIVITY times the likeness of activity. Inactive frames do not
    count; a place with less than half of the block's frames scores 0."""
    n, b = len(sv), len(tv)
    sv, tv = sv.astype(float), tv.astype(float)

    def cosines(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        norms = np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((y * y).sum(axis=1))[None, :]
        some = ((x * x).sum(axis=1) > 2.3e-16)[:, None] & ((y * y).sum(axis=1) > 2.3e-16)[None, :]
        return np.where(some, (x @ y.T) / np.where(some, norms, 1), 0), some

    absolute = np.clip(cosines(sv, tv)[0], 0, 1)
    change, some = cosines(np.diff(sv, axis=0, prepend=sv[:1]), np.diff(tv, axis=0, prepend=tv[:1]))
    change = np.where(some, np.clip((change + 1) * 0.5, 0, 1), 0)
    like = np.clip(1 - np.abs(sa[:, None].astype(float) - ta[None, :]) / 1000, 0, 1)
    counts = (sa >= LEAST_ACTIVE)[:, None] & (ta >= LEAST_ACTIVE)[None, :]
    places = n - b + 1
    total, compared, before = np.zeros(places), np.zeros(places, int), np.zeros(places, bool)
    for k in range(b):
        at = slice(k, k + places)
        now = counts[at, k]
        own = absolute[at, k]
        moved = np.where(before, change[at, k], own)
        total = np.where(now, total + (own * ABSOLUTE + moved * CHANGE + like[at, k] * ACTIVITY), total)
        compared = compared + now
        before = now
    enough = compared >= -(-b // 2)
    return np.where(enough, total / np.maximum(compared, 1) * (compared / max(b, 1)), 0.0)


def fold_best_two(scores: np.ndarray, radius: int, first: int = 0) -> tuple[int, float, int | None, float | None]:
    """(place, score, second place, second score), going through the places in order: a higher score becomes the best; the
    old best is second then, if it is more than ``radius`` away. Any other place that far from the best is second if higher."""
    record = np.maximum.accumulate(scores)
    heads = np.flatnonzero(np.concatenate([[True], scores[1:] > record[:-1]]))
    second: tuple[int, float] | None = None
    for k, head in enumerate(heads):
        if k and head - heads[k - 1] > radius:
            second = int(heads[k - 1]), float(scores[heads[k - 1]])
        end = heads[k + 1] if k + 1 < len(heads) else len(scores)
        rest = scores[head + radius + 1 : end]
        if len(rest):
            i = int(rest.argmax())
            if second is None or rest[i] > second[1]:
                second = int(head + radius + 1 + i), float(rest[i])
    best = int(heads[-1])
    return best + first, float(scores[best]), second[0] + first if second else None, second[1] if second else None


def best_two_apart(scores: DataFrame, key: list[str], place: str, score: str, radius: int) -> DataFrame:
    """``fold_best_two`` of each key's rows by windows and aggregates, for any number of rows: key, place, score, second_place,
    second_score. A place occurs once in a key; null scores are left out."""
    s = scores.filter(F.col(score).isNotNull())
    w = Window.partitionBy(*key).orderBy(place)
    before = F.max(score).over(w.rowsBetween(Window.unboundedPreceding, -1))
    heads = s.withColumn("_head", F.when(before.isNull() | (F.col(score) > before), F.struct(F.col(place).alias("at"), F.col(score).alias("of"))))
    best = F.last("_head", ignorenulls=True)
    held = heads.withColumn("_best", best.over(w)).withColumn("_old", best.over(w.rowsBetween(Window.unboundedPreceding, -1)))
    is_head = F.col("_head").isNotNull()
    # A new best more than the radius from the old one resets the second to the old one; later places count from there.
    reset = is_head & (F.col("_best.at") - F.col("_old.at") > radius)
    far = ~is_head & (F.col(place) - F.col("_best.at") > radius)
    better_first = lambda at, of: F.struct(of.alias("of"), (-at).alias("at"))
    offered = F.when(reset, better_first(F.col("_old.at"), F.col("_old.of"))).when(far, better_first(F.col(place), F.col(score)))
    lasts = held.withColumn("_offer", offered).withColumn("_reset", F.when(reset, F.col(place)))
    lasts = lasts.withColumn("_since", F.max("_reset").over(Window.partitionBy(*key)))
    found = lasts.groupBy(*key).agg(
        F.max_by("_best", F.col(place)).alias("b"),
        F.max(F.when(F.col("_since").isNull() | (F.col(place) >= F.col("_since")), F.col("_offer"))).alias("o"),
    )
    return found.select(*key, F.col("b.at").alias("place"), F.col("b.of").alias("score"), (-F.col("o.at")).alias("second_place"), F.col("o.of").alias("second_score"))


def _flat(frames: str, into: str) -> list[Column]:
    return [F.flatten(F.transform(frames, lambda x: x["values"])).alias(f"{into}_values"), F.transform(frames, lambda x: x["active"]).alias(f"{into}_active")]


def _in_order() -> Column:
    return F.array_sort(F.collect_list(F.struct("frame", F.col("values").cast("array<double>").alias("values"), F.col("active").cast("int").alias("active"))))


def located(source: DataFrame, target: DataFrame, requests: DataFrame, block: int, radius: int | None = None) -> DataFrame:
    """requests (pair, request, start, low, high): the target block at frame ``start`` is looked for at the source places
    ``low`` to ``high``. Returns them with place, score, margin (to the best place more than ``radius`` away, or to 0).
    Requests whose block or places reach beyond the frames have no row."""
    radius = 2 * block if radius is None else radius
    of_block = requests.select("pair", "request", F.explode(F.sequence("start", F.col("start") + block - 1)).alias("frame"))
    blocks = of_block.join(target, ["pair", "frame"]).groupBy("pair", "request").agg(_in_order().alias("f")).filter(F.size("f") == block).select("pair", "request", *_flat("f", "t"))
    first = F.greatest(F.lit(0), F.floor((F.col("frame") - block + 1) / PLACES))
    held = source.select("pair", "frame", "values", "active", F.explode(F.sequence(first, F.floor(F.col("frame") / PLACES))).alias("chunk"))
    chunks = held.groupBy("pair", "chunk").agg(_in_order().alias("f"))
    chunks = chunks.select("pair", "chunk", F.col("f")[0]["frame"].alias("from"), *_flat("f", "s"))
    asked = requests.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("low") / PLACES), F.floor(F.col("high") / PLACES))))
    met = asked.join(blocks, ["pair", "request"]).join(chunks, ["pair", "chunk"])
    types = {f.name: f.dataType.simpleString() for f in requests.schema.fields}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, firsts, found = [], [], []
            for i in range(b.num_rows):
                sv, sa, tv, ta = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("s_values", "s_active", "t_values", "t_active"))
                sv, tv = sv.reshape(len(sa), -1), tv.reshape(len(ta), -1)
                begin, chunk = b.column("from")[i].as_py(), b.column("chunk")[i].as_py()
                low = max(b.column("low")[i].as_py(), chunk * PLACES)
                high = min(b.column("high")[i].as_py(), chunk * PLACES + PLACES - 1, begin + len(sa) - len(ta))
                if high >= low:
                    keys.append(i)
                    firsts.append(low)
                    found.append(place_scores(sv[low - begin : high - begin + len(ta)], sa[low - begin : high - begin + len(ta)], tv, ta))
            at = pa.array(keys, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("pair").take(at), b.column("request").take(at), pa.array(firsts, pa.int64()), pa.array(found, pa.list_(pa.float64()))], ["pair", "request", "first", "scores"])

    scored = met.select("pair", "request", "low", "high", "chunk", "from", "s_values", "s_active", "t_values", "t_active").mapInArrow(score, f"pair {types['pair']}, request {types['request']}, first long, scores array<double>")

    def fold(table: pa.Table) -> pa.Table:
        order = np.argsort(table["first"].to_numpy())
        scores = np.concatenate([np.asarray(table["scores"][int(i)].as_py()) for i in order])
        place, best, _, second = fold_best_two(scores, radius, table["first"][int(order[0])].as_py())
        return pa.Table.from_arrays([table["pair"].slice(0, 1), table["request"].slice(0, 1), pa.array([place]), pa.array([best]), pa.array([max(0.0, best - (second or 0.0))])], ["pair", "request", "place", "score", "margin"])

    found = scored.groupBy("pair", "request").applyInArrow(fold, f"pair {types['pair']}, request {types['request']}, place long, score double, margin double")
    return requests.select("pair", "request", "start").join(found, ["pair", "request"])


def _timed(found: DataFrame, source: DataFrame, target: DataFrame, block: int) -> DataFrame:
    """``found`` with the times of the middle frames."""
    middle = lambda df, name: df.select("pair", F.col("frame").alias(f"_{name}"), F.col("time_ms").alias(f"{name}_ms"))
    at = found.withColumn("_source", F.col("place") + block // 2).withColumn("_target", F.col("start") + block // 2)
    return at.join(middle(source, "source"), ["pair", "_source"]).join(middle(target, "target"), ["pair", "_target"]).drop("_source", "_target")


def _spread(lengths: DataFrame, block: int, stride: int, most: int) -> DataFrame:
    """(pair, request, start): blocks each ``stride`` frames and one at the end, of which ``most`` evenly spread ones stay."""
    steps = F.sequence(F.lit(0), F.col("n") - block, F.lit(max(1, stride)))
    full = F.when(F.element_at(steps, -1) + block < F.col("n"), F.concat(steps, F.array(F.col("n") - block))).otherwise(steps)
    some = lengths.filter(F.col("n") >= block).select("pair", full.cast("array<long>").alias("a"))
    even = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get("a", F.floor(i * (F.size("a") - 1) / max(1, most - 1)).cast("int")))
    taken = F.when(F.size("a") > most, F.array_distinct(even)).otherwise(F.col("a"))
    return some.select("pair", F.posexplode(taken).alias("request", "start")).withColumn("request", F.col("request").cast("long"))


def locate_blocks(source: DataFrame, target: DataFrame, block: int = 40, stride: int = 240, most_blocks: int = 32) -> DataFrame:
    """(pair, request, start, place, score, margin, source_ms, target_ms, held_out): the target's blocks, spread over it, at
    their best places in the whole source. Every fifth one, from the third on, is held out. A pair without a frame on one
    side, or with fewer than a block's, has no row."""
    length = lambda df, n: df.groupBy("pair").agg(F.count("*").alias(n))
    wanted = _spread(length(target, "n"), block, stride, most_blocks)
    reach = length(source, "m").filter(F.col("m") >= block)
    requests = wanted.join(reach, "pair").select("pair", "request", "start", F.lit(0).cast("long").alias("low"), (F.col("m") - block).alias("high"))
    found = _timed(located(source, target, requests, block), source, target, block)
    return found.withColumn("held_out", F.col("request") % HELD_OUT[0] == HELD_OUT[1])


def summary(blocks: DataFrame, least_score: float = 0.48, least_margin: float = 0.001) -> DataFrame:
    """Per pair: blocks asked for, accepted by score, distinctive and not held out; best and median score and margin (the
    upper median)."""
    good = F.col("score") >= least_score
    upper = lambda c: F.element_at(F.array_sort(F.collect_list(c)), (F.floor(F.count("*") / 2) + 1).cast("int"))
    return blocks.groupBy("pair").agg(
        F.count("*").alias("n_blocks"), F.count(F.when(good, 1)).alias("n_accepted"), F.count(F.when(good & (F.col("margin") >= least_margin) & ~F.col("held_out"), 1)).alias("n_training"),
        F.max("score").alias("best_score"), upper("score").alias("median_score"), F.max("margin").alias("best_margin"), upper("margin").alias("median_margin"),
    )


def hypotheses(blocks: DataFrame, bounds: DataFrame, least_score: float = 0.48, least_margin: float = 0.001, tolerance: int = 120_000, least_training: int = 5, most: int = 3) -> DataFrame:
    """(pair, rank, offset_ms, n_training, source_start_ms, source_end_ms, coverage, p50_ms, p95_ms, max_ms, score) from
    ``locate_blocks``; bounds (pair, start_ms, end_ms): what the target's blocks can cover.

    Every distinct offset of a training block is a seed; the upper median of the offsets within the tolerance is a
    hypothesis, and what lies within the tolerance of that supports it. ``least_training`` supporters and a coverage of 0.35
    are needed. Order: supporters, coverage, score, 95th percentile of residuals, offset. A hypothesis within the tolerance of
    one before it is left out; ``most`` stay."""
    t = blocks.filter((F.col("score") >= least_score) & (F.col("margin") >= least_margin) & ~F.col("held_out"))
    t = t.select("pair", "request", "source_ms", "target_ms", "score", (F.col("target_ms") - F.col("source_ms")).alias("offset"))
    seeds = t.select(F.col("pair").alias("_pair"), F.col("offset").alias("seed")).distinct()
    near = t.join(seeds, (F.col("pair") == F.col("_pair")) & (F.abs(F.col("offset") - F.col("seed")) <= tolerance)).drop("_pair")
    sorted_offsets = F.array_sort(F.collect_list("offset"))
    middles = near.groupBy("pair", "seed").agg(sorted_offsets.alias("a")).filter(F.size("a") >= least_training)
    middles = middles.select("pair", "seed", F.expr("a[size(a) div 2]").alias("offset_ms"))
    kept = near.join(middles, ["pair", "seed"]).filter(F.abs(F.col("offset") - F.col("offset_ms")) <= tolerance)
    residuals = F.array_sort(F.collect_list(F.abs(F.col("offset") - F.col("offset_ms"))))
    grouped = kept.groupBy("pair", "seed", "offset_ms").agg(
        F.count("*").alias("n_training"), F.min("source_ms").alias("source_start_ms"), F.max("source_ms").alias("source_end_ms"), (F.max("target_ms") - F.min("target_ms")).alias("reach"), F.avg("score").alias("mean"), residuals.alias("r"),
    )
    covered = grouped.join(bounds, "pair").withColumn("coverage", F.col("reach") / F.greatest(F.lit(1), F.col("end_ms") - F.col("start_ms")))
    covered = covered.filter((F.col("n_training") >= least_training) & (F.col("coverage") >= LEAST_COVERAGE))
    at = lambda p: F.get("r", F.ceil((F.size("r") - 1) * p / 100).cast("int"))
    share = F.least(F.lit(1.0), F.col("coverage"))
    support = F.least(F.lit(1.0), F.col("n_training") / FULL_SUPPORT)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("mean") * BLOCK_SHARE + share * COVERAGE_SHARE + support * SUPPORT_SHARE))
    one = F.struct(
        (-F.col("n_training")).alias("k1"), (-share).alias("k2"), (-score).alias("k3"), at(95).alias("p95_ms"), "offset_ms", "n_training", "source_start_ms", "source_end_ms", share.alias("coverage"), at(50).alias("p50_ms"), F.element_at("r", -1).alias("max_ms"), score.alias("score"),
    )
    listed = covered.groupBy("pair").agg(F.array_sort(F.collect_list(one)).alias("h"))
    none = F.filter("h", lambda x: F.lit(False))
    apart = F.aggregate("h", none, lambda got, x: F.when(F.exists(got, lambda y: F.abs(y["offset_ms"] - x["offset_ms"]) <= tolerance), got).otherwise(F.concat(got, F.array(x))))
    ranked = listed.select("pair", F.posexplode(F.slice(apart, 1, most)).alias("rank", "x"))
    return ranked.select("pair", (F.col("rank") + 1).alias("rank"), *[f"x.{c}" for c in ("offset_ms", "n_training", "source_start_ms", "source_end_ms", "coverage", "p50_ms", "p95_ms", "max_ms", "score")])


def held_out(source: DataFrame, target: DataFrame, blocks: DataFrame, found: DataFrame, block: int = 40, frame_ms: int = 500, least_score: float = 0.48, least_margin: float = 0.001, tolerance: int = 120_000, every_ms: int = EVERY_MS) -> DataFrame:
    """(pair, rank, source_ms, target_ms, residual_ms, score, margin): blocks that had no say in a hypothesis, at their places.

    A block every ``every_ms`` that is a block's length away from all that support the hypothesis is looked for within the
    tolerance of where the hypothesis says; it counts with ``least_score`` and ``least_margin``. The blocks that were held out
    from the vote are added if their score suffices. Of blocks nearer to each other than a block's length, in order of target
    and source, those after one that stays are left out."""
    blocks, found = graph.cut(blocks), graph.cut(found)  # both are read several times
    step, around, length = max(1, every_ms // frame_ms), tolerance // frame_ms, block * frame_ms
    sizes = target.groupBy("pair").agg(F.count("*").alias("n")).join(source.groupBy("pair").agg(F.count("*").alias("m")), "pair").filter((F.col("n") >= block) & (F.col("m") >= block))
    starts = sizes.filter(F.col("n") - block >= step).select("pair", "m", F.explode(F.sequence(F.lit(step), F.col("n") - block, F.lit(step))).alias("start"))
    middle = target.select("pair", (F.col("frame") - block // 2).alias("start"), F.col("time_ms").alias("target_ms"))
    asked = starts.join(middle, ["pair", "start"]).join(found.select("pair", "rank", "offset_ms"), "pair")
    offset = blocks.withColumn("_o", F.col("target_ms") - F.col("source_ms")).filter((F.col("score") >= least_score) & (F.col("margin") >= least_margin) & ~F.col("held_out"))
    support = found.select("pair", "rank", "offset_ms").join(offset.select("pair", "_o", F.col("target_ms").alias("used_ms")), "pair").filter(F.abs(F.col("_o") - F.col("offset_ms")) <= tolerance)
    asked = intervals.near_exists(asked, support.select("pair", "rank", "used_ms"), "target_ms", "used_ms", length - 1, ["pair", "rank"], "left_anti")
    # The first source frame at or after the time that the hypothesis says, or the last one.
    asked = asked.withColumn("wanted", F.col("target_ms") - F.col("offset_ms")).withColumn("request", F.monotonically_increasing_id())
    before = F.lag("time_ms").over(Window.partitionBy("pair").orderBy("frame"))
    spans = source.select("pair", F.col("frame").alias("_at"), (before + 1).alias("_a"), (F.col("time_ms") + 1).alias("_z")).filter("_a is not null")
    hit = intervals.range_join(asked.select("pair", "request", "wanted"), spans, "wanted", "_a", "_z", ["pair"], width=max(1, frame_ms) * 64).select("request", "_at")
    ends = source.groupBy("pair").agg(F.min("time_ms").alias("first_ms"))
    placed = asked.join(hit, "request", "left").join(ends, "pair").withColumn("_at", F.coalesce("_at", F.when(F.col("wanted") <= F.col("first_ms"), 0).otherwise(F.col("m") - 1)))
    begin = F.greatest(F.lit(0), F.col("_at") - block // 2)
    low, high = F.greatest(F.lit(0), begin - around), F.least(begin + around, F.col("m") - block)
    requests = placed.select("pair", "request", "start", low.cast("long").alias("low"), high.cast("long").alias("high"), "rank", "offset_ms").filter("high >= low")
    dense = _timed(located(source, target, requests.select("pair", "request", F.col("start").cast("long").alias("start"), "low", "high"), block), source, target, block)
    dense = dense.filter((F.col("score") >= least_score) & (F.col("margin") >= least_margin)).join(requests.select("request", "rank", "offset_ms"), "request")
    kept = blocks.filter(F.col("held_out") & (F.col("score") >= least_score)).join(found.select("pair", "rank", "offset_ms"), "pair")
    cols = ["pair", "rank", "source_ms", "target_ms", "offset_ms", "score", "margin"]
    both = dense.select(*cols).unionByName(kept.select(*cols))
    listed = both.groupBy("pair", "rank").agg(F.array_sort(F.collect_list(F.struct("target_ms", "source_ms", "offset_ms", "score", "margin"))).alias("h"))
    none = F.filter("h", lambda x: F.lit(False))
    apart = F.aggregate("h", none, lambda got, x: F.when((F.size(got) > 0) & (F.abs(F.element_at(got, -1)["target_ms"] - x["target_ms"]) < length), got).otherwise(F.concat(got, F.array(x))))
    rows = listed.select("pair", "rank", F.explode(apart).alias("x"))
    return rows.select("pair", "rank", "x.source_ms", "x.target_ms", (F.col("x.target_ms") - F.col("x.source_ms") - F.col("x.offset_ms")).alias("residual_ms"), "x.score", "x.margin")
