"""Evidence for time maps: offsets by block search, boundaries by correlation, held-out blocks, greedy matches, quality levels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from .solve import near_in_time

# Fixed values of the block search.
BLOCK_MOST, BLOCK_LEAST, STEPS_A_BLOCK = 24, 4, 4


def block_offsets(source: DataFrame, complete: DataFrame, key: str, t: str, vec: str, step: int, margin: int = 60_000, most: int = 240_000) -> DataFrame:
    """For blocks of source frames the offset at which the complete recording is nearest: key, i (the block's middle
    frame), source_ms, offset_ms, distance (mean over the block).

    Frames of a key are numbered in order of time, ``step`` milliseconds apart. Offsets reach ``margin`` beyond the
    difference of both ends, and ``most`` at most. A frame meets each offset once, by an equality on its number, and
    blocks are sums over windows. Of equal distances the smallest offset stays. Keys without a fitting block give no row.
    """
    by_time = Window.partitionBy(key).orderBy(t)
    number = lambda df, p: df.select(key, F.col(t).alias(f"{p}_t"), F.col(vec).alias(f"{p}_v"), (F.row_number().over(by_time) - 1).alias(f"{p}_i"))
    s, c = number(source, "s"), number(complete, "c")
    size = F.when(F.col("n") <= BLOCK_LEAST, F.col("n")).otherwise(F.least(F.lit(BLOCK_MOST), F.greatest(F.lit(BLOCK_LEAST), F.floor(F.col("n") / 4))))
    longer = F.col("c_end") - F.col("s_end")
    low = F.floor(F.greatest(F.lit(-most), F.least(F.lit(0), longer) - margin) / step)
    high = F.ceil(F.least(F.lit(most), F.greatest(F.lit(0), longer) + margin) / step)
    ends = s.groupBy(key).agg(F.max("s_t").alias("s_end"), F.count("*").alias("n")).join(c.groupBy(key).agg(F.max("c_t").alias("c_end"), F.count("*").alias("m")), key)
    plan = ends.select(key, "n", "m", size.cast("int").alias("size"), low.alias("low"), high.alias("high"))
    # Only offsets at which the frame has a counterpart are made.
    offsets = F.sequence(F.greatest("low", -F.col("s_i")), F.least("high", F.col("m") - 1 - F.col("s_i")))
    possible = F.greatest("low", -F.col("s_i")) <= F.least("high", F.col("m") - 1 - F.col("s_i"))
    pairs = s.join(plan, key).filter(possible).withColumn("o", F.explode(offsets)).withColumn("c_i", F.col("s_i") + F.col("o")).join(c, [key, "c_i"])
    frames = pairs.select(key, "s_i", "o", "n", "size", "s_t", (F.col("c_t") - F.col("s_t")).alias("offset_ms"), X.rms_distance(F.col("c_v"), F.col("s_v")).alias("d"))
    # The last frames of the largest block; a smaller block takes the end of them.
    along = Window.partitionBy(key, "o").orderBy("s_i")
    half = F.floor(F.col("size") / 2)
    centre_of = F.col("s_i") - F.col("size") + 1 + half
    lists = frames.withColumn("_d", F.collect_list("d").over(along.rowsBetween(-(BLOCK_MOST - 1), 0))).filter(F.size("_d") >= F.col("size"))
    total = F.aggregate(F.slice("_d", F.size("_d") - F.col("size") + 1, F.col("size")), F.lit(0.0), lambda a, x: a + x)
    blocks = lists.select(key, centre_of.alias("i"), "o", "n", "size", (total / F.col("size")).alias("distance"))
    hop = F.greatest(F.lit(1), F.floor(F.col("size") / STEPS_A_BLOCK + 0.5))
    on_grid = (F.col("i") >= half) & (F.col("i") < F.col("n") - half) & ((F.col("i") - half) % hop == 0)
    wanted = blocks.withColumn("_grid", on_grid).filter(F.col("_grid") | (F.col("i") == F.floor(F.col("n") / 2)))
    best = wanted.groupBy(key, "i").agg(F.max("_grid").alias("_grid"), F.min(F.struct("distance", "o")).alias("b"))
    # Without any block of the grid, the one in the middle stands for all.
    kept = best.withColumn("_any", F.max("_grid").over(Window.partitionBy(key))).filter("_grid or not _any")
    at = kept.select(key, "i", (F.col("i") + F.col("b.o")).alias("c_i"), F.col("b.distance").alias("distance"))
    named = at.join(s.select(key, F.col("s_i").alias("i"), "s_t"), [key, "i"]).join(c.select(key, "c_i", "c_t"), [key, "c_i"])
    return named.select(key, F.col("i").cast("long").alias("i"), F.col("s_t").alias("source_ms"), (F.col("c_t") - F.col("s_t")).alias("offset_ms"), "distance")


def _windows(samples: np.ndarray, centres: np.ndarray, size: int, side: str) -> tuple[np.ndarray, np.ndarray]:
    """Which of the windows lie inside, and those, each less its mean."""
    start = centres - {"centred": size // 2, "before": size, "after": 0}[side]
    inside = (start >= 0) & (start + size <= len(samples))
    if not inside.any():
        return inside, np.zeros((0, size))
    w = np.lib.stride_tricks.sliding_window_view(samples, size)[start[inside]].astype(float)
    return inside, w - w.mean(axis=1, keepdims=True)


def refined(source: np.ndarray, target: np.ndarray, at: int, coarse: int, rate: int, radius: int, window: int, tolerance: float, least: float, margin: float, widest: int, side: str) -> tuple | None:
    """(shift, uncertainty start, uncertainty end, correlation, margin, ambiguous) of one boundary; None where it cannot be known."""
    sample = lambda ms: (ms * rate + 500) // 1000
    size = sample(window)
    if size < 8 or at < 0 or coarse - radius < 0:
        return None
    ok, own = _windows(source, np.array([sample(at)]), size, side)
    shifts = np.arange(-radius, radius + 1)
    inside, others = _windows(target, np.array([sample(coarse + int(s)) for s in shifts]), size, side)
    if not ok.any() or not inside.any():
        return None
    shifts = shifts[inside]
    power = np.sqrt((own[0] ** 2).sum() * (others**2).sum(axis=1))
    c = np.where(power <= np.finfo(float).eps, 0.0, np.clip(others @ own[0] / np.where(power > 0, power, 1), -1, 1))
    k = np.lexsort((shifts, np.abs(shifts), -c))[0]
    below = np.flatnonzero(c < c[k] - tolerance)
    left = below[below < k].max(initial=-1) + 1
    right = below[below > k].min(initial=len(c)) - 1
    rest = np.concatenate([c[:left], c[right + 1 :]])
    gap = max(0.0, float(c[k] - (rest.max() if len(rest) else -1.0)))
    wide = int(shifts[right] - shifts[left])
    return int(shifts[k]), coarse + int(shifts[left]), coarse + int(shifts[right]), float(c[k]), gap, bool(c[k] < least or gap < margin or wide > widest)


def refine_boundaries(df: DataFrame, source: str, target: str, at: str, coarse: str, rate: int = 16_000, radius: int = 500, window: int = 400, tolerance: float = 0.01, least: float = 0.55, margin: float = 0.01, widest: int = 120, side: str = "centred") -> DataFrame:
    """``df`` with each coarse target boundary moved to the best correlation within ``radius`` milliseconds.

    ``source`` and ``target`` hold samples as arrays. Shifts next to the best whose correlation is within
    ``tolerance`` are its uncertainty; only peaks outside count as others. ``side`` says whether the window lies around,
    before or after the boundary. Ambiguous: correlation under ``least``, margin under ``margin`` or uncertainty over
    ``widest``. Nulls, and windows that lie outside the samples, give null results. Arrow batches, no shuffle.
    """

    @F.pandas_udf("shift_ms long, uncertain_from_ms long, uncertain_to_ms long, correlation double, margin double, ambiguous boolean")
    def run(s: pd.Series, t: pd.Series, a: pd.Series, c: pd.Series) -> pd.DataFrame:
        rows = [None if x is None or y is None or pd.isna(p) or pd.isna(q) else refined(np.asarray(x), np.asarray(y), int(p), int(q), rate, radius, window, tolerance, least, margin, widest, side) for x, y, p, q in zip(s, t, a, c)]
        cols = list(zip(*[r or (None,) * 6 for r in rows])) or [()] * 6
        kinds = ("Int64", "Int64", "Int64", "Float64", "Float64", "boolean")
        names = ("shift_ms", "uncertain_from_ms", "uncertain_to_ms", "correlation", "margin", "ambiguous")
        return pd.DataFrame({n: pd.array(x, k) for n, x, k in zip(names, cols, kinds)})

    found = df.withColumn("_r", run(F.col(source), F.col(target), F.col(at).cast("long"), F.col(coarse).cast("long")))
    return found.withColumn("refined_ms", F.col(coarse) + F.col("_r.shift_ms")).select("*", "_r.*").drop("_r")


def _picked(slot: pd.Series, n: pd.Series, width: pd.Series) -> pd.Series:
    """A place in a stratum from its number and the number of blocks: a 64-bit mix, modulo the width."""
    with np.errstate(over="ignore"):
        k = n.to_numpy().astype(np.uint64)
        v = (slot.to_numpy().astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ (k << np.uint64(17) | k >> np.uint64(47))
        v = (v ^ v >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        v = (v ^ v >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        v = v ^ v >> np.uint64(31)
    return pd.Series((v % width.to_numpy().astype(np.uint64)).astype(np.int64))


def holdout_blocks(points: DataFrame, key: str, t: str, point_id: str, minimum: int, width: int = 1_000, most: int = 1_024) -> DataFrame:
    """(key, block) of the time blocks that are held out: about a fifth of a key's blocks, one from each of so many
    equal strata, two at least and ``most`` at most. A block that would leave fewer than ``minimum`` points for training
    is passed over; with fewer than two blocks left to hold out there are none."""
    blocks = points.groupBy(key, F.floor(F.col(t) / width).alias("block")).agg(F.countDistinct(point_id).alias("size"))
    whole = Window.partitionBy(key)
    ranked = blocks.withColumn("i", F.row_number().over(whole.orderBy("block")) - 1).withColumn("n", F.count("*").over(whole)).withColumn("total", F.sum("size").over(whole))
    held = F.least(F.greatest(F.ceil(F.col("n") / 5), F.lit(2)), F.col("n") - 1, F.lit(most))
    usable = ranked.filter((F.col("n") >= 3) & (F.col("total") - minimum >= 2)).withColumn("h", held)
    slots = usable.withColumn("slot", F.floor(((F.col("i") + 1) * F.col("h") - 1) / F.col("n")))
    start = lambda s: F.floor(s * F.col("n") / F.col("h"))
    cut = slots.withColumn("a", start(F.col("slot"))).withColumn("w", start(F.col("slot") + 1) - F.col("a"))
    mixed = F.pandas_udf(_picked, "long")
    picked = cut.filter(F.col("a") + mixed("slot", "n", "w") == F.col("i"))
    # At most ``most`` blocks a key from here on.
    rows = picked.groupBy(key).agg(F.first("total").alias("total"), F.array_sort(F.collect_list(F.struct("block", "size"))).alias("bs"))
    none = F.array().cast("array<bigint>")
    fold = F.aggregate(
        "bs",
        F.struct(F.col("total").alias("left"), none.alias("got")),
        lambda acc, b: F.when(acc["left"] - b["size"] >= minimum, F.struct((acc["left"] - b["size"]).alias("left"), F.concat(acc["got"], F.array(b["block"])).alias("got"))).otherwise(acc),
    )
    return rows.select(key, fold["got"].alias("got")).filter(F.size("got") >= 2).select(key, F.explode("got").alias("block"))


SIDES = ("source_start_ms", "source_end_ms", "target_start_ms", "target_end_ms")


def greedy_matches(gold: DataFrame, predicted: DataFrame, key: str, event_id: str = "event_id", kind: str = "kind", within: int = 2_000) -> DataFrame:
    """Gold and predicted edits matched greedily: least largest error of the four borders first, then least sum,
    same kind, earlier gold edit, earlier predicted edit. Errors over ``within`` never match.

    Candidates come from a join on time bins; a stretch of time in which source starts follow each other within
    ``within`` is one group, as no match leaves it.
    """
    side = lambda df, p, at: df.select(key, F.col("source_start_ms").alias(at), F.struct("source_start_ms", "target_start_ms", F.col(event_id).alias("id"), F.col(kind).alias("kind"), "source_end_ms", "target_end_ms").alias(p))
    near = near_in_time(side(gold, "gold", "g"), side(predicted, "pred", "p"), [key], within)
    errors = F.array(*[F.abs(F.col(f"gold.{c}") - F.col(f"pred.{c}")) for c in SIDES])
    rows = near.withColumn("e", errors).select(
        key, "_stretch", F.array_max("e").alias("max_error_ms"), F.aggregate("e", F.lit(0).cast("long"), lambda a, x: a + x).alias("total_error_ms"), (F.col("gold.kind") != F.col("pred.kind")).alias("other_kind"),
        *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("gold", "pred") for c in ("source_start_ms", "target_start_ms", "id")],
    ).filter(F.col("max_error_ms") <= within)
    order = ["max_error_ms", "total_error_ms", "other_kind", *[f"{s}_{c}" for s in ("gold", "pred") for c in ("source_start_ms", "target_start_ms", "id")]]

    listed = rows.groupBy(key, "_stretch").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("c"))

    @F.pandas_udf(listed.schema["c"].dataType)
    def greedy(lists: pd.Series) -> pd.Series:
        out = []
        for c in lists:
            gold_used, pred_used, keep = set(), set(), []
            for x in c:
                if x["gold_id"] not in gold_used and x["pred_id"] not in pred_used:
                    keep.append(x)
                    gold_used.add(x["gold_id"])
                    pred_used.add(x["pred_id"])
            out.append(keep)
        return pd.Series(out, dtype=object)

    return listed.select(key, F.inline(greedy("c"))).select(key, "gold_id", F.col("pred_id").alias("predicted_id"), "max_error_ms", "total_error_ms", "other_kind")


def _codes(*rules: tuple[str, Column]) -> Column:
    """Codes of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))


def map_quality(df: DataFrame) -> DataFrame:
    """``df`` with level (verified, review, blocked), complete and reasons (codes) of each time map's metrics.

    Impossible metrics, missing evidence and failed limits block; missing metrics and unmet goals ask for a review;
    verified needs measured metrics, two independent kinds of evidence (or a person's) and every goal.
    """
    c = F.col
    share = lambda n: (n, F.isnan(n) | (c(n) < 0) | (c(n) > 1))
    whole = lambda n: (n, c(n) < 0)
    residuals = ("p50_residual_ms", "p95_residual_ms", "p99_residual_ms", "max_residual_ms")
    invalid = _codes(
        share("probability"), share("coverage"), share("unique_coverage"), *[whole(n) for n in residuals], whole("boundary_uncertainty_ms"), share("alternative_margin"), whole("anchors"),
        ("regions", (c("regions") < 0) | (c("regions") > 3)), ("held_out", (c("held_out") < 0) | (c("held_out") > c("anchors"))), whole("evidence_held_out"),
        *[(f"{a}>{b}", c(a) > c(b)) for a, b in zip(residuals, residuals[1:])],
    )
    has = lambda e: F.array_contains("evidence", e)
    media = has("audio") | has("visual")
    stream = F.when(c("source_stream") == "video", "visual").otherwise(c("source_stream"))
    same_stream = F.coalesce((c("source_stream") == c("target_stream")) & F.array_contains(c("evidence"), stream), F.lit(False))
    integrity = _codes(("audioAnchors", has("audio") & (c("audio_anchors") <= 0)), ("visualAnchors", has("visual") & (c("visual_anchors") <= 0)), ("streams", media & ~same_stream))
    failed = _codes(("coverageLow", c("coverage") < 0.2), ("residualHigh", c("p95_residual_ms") > 2_000), ("boundaryWide", c("boundary_uncertainty_ms") > 5_000), ("marginLow", c("alternative_margin") < 0.02))
    known = (c("anchors") > 0) & (c("held_out") > 0) & (c("evidence_held_out") == c("held_out"))
    for n in ("probability", "coverage", *residuals, "boundary_uncertainty_ms", "alternative_margin"):
        known = known & c(n).isNotNull()
    independent = has("manual") | (has("audio") & has("visual"))
    reached = (
        (c("probability") >= 0.995) & (c("coverage") >= 0.9) & (c("p95_residual_ms") <= 100) & (c("p99_residual_ms") <= 500) & (c("boundary_uncertainty_ms") <= 250)
        & (c("alternative_margin") >= 0.25) & (c("anchors") >= 30) & (c("regions") >= 3) & (c("unique_coverage") >= 0.8)
    )
    measured = c("metric_source") == "measured"
    fair = (c("coverage") >= 0.7) & (c("p95_residual_ms") <= 400) & (c("boundary_uncertainty_ms") <= 1_000) & (c("alternative_margin") >= 0.1)
    short = F.concat(_codes(("notMeasured", ~measured), ("oneEvidence", ~independent), ("probabilityLow", c("probability") < 0.995)), integrity)
    bad, primary = F.size(invalid) > 0, media | has("manual")
    verified = F.coalesce(measured & independent & (F.size(integrity) == 0) & reached, F.lit(False))
    complete = F.coalesce(~bad & known, F.lit(False))
    level = F.when(bad | ~primary | (F.size(failed) > 0), "blocked").when(complete & verified, "verified").otherwise("review")
    one = lambda code: F.array(F.lit(code))
    reasons = F.when(bad, invalid).when(~primary, one("noEvidence")).when(F.size(failed) > 0, failed).when(~complete, one("incomplete")).when(verified, one("verified"))
    reasons = reasons.when(~F.coalesce(fair, F.lit(False)), one("unverified")).when(F.size(short) > 0, short).otherwise(one("usable"))
    return df.withColumn("level", level).withColumn("complete", complete).withColumn("reasons", reasons)


def reconciled_level(declared: Column, assessed: Column) -> Column:
    """A declared level, which may be below the assessed one but not above; legacy levels stay."""
    kept = declared.isin("legacy-unverified", "blocked") | ((declared == "review") & (assessed != "blocked"))
    return F.when(kept, declared).otherwise(assessed)
