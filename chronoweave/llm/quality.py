"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad; its potential comes from its own features and those of the lines before and after
it, and a transition weight ties neighbours together. Forward-backward gives each line's marginal; a document's
quality is their mean by line length, mapped to a probability by a logistic curve.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Training takes labelled documents with the smallest hash of their id, this many at most, of these lines at most.
SAMPLE_DOCS = 4000
SAMPLE_LINES = 400
STEPS = 250

_LOWER, _UPPER, _DIGIT, _SPACE, _PLAIN, _BANG, _SYMBOL, _HIGH = range(1, 9)


def _classes() -> np.ndarray:
    out = np.full(256, _SYMBOL, np.uint8)
    out[:32] = 0
    for c in map(chr, range(32, 128)):
        if c.islower():
            out[ord(c)] = _LOWER
        elif c.isupper():
            out[ord(c)] = _UPPER
        elif c.isdigit():
            out[ord(c)] = _DIGIT
    out[[9, 13, 32]] = _SPACE
    out[list(b".,;:'\"()-?")] = _PLAIN
    out[ord("!")] = _BANG
    out[128:] = _HIGH
    return out


_CLASS = _classes()
FEATURES = 16


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, length of each line, lines of each text). A text without a line break is one line."""
    lines = [t.split("\n") for t in texts]
    per_text = np.array([len(x) for x in lines])
    data = ("\n".join(texts) + "\n").encode("utf-8", "surrogatepass")
    a = np.frombuffer(data, dtype=np.uint8)
    ends = np.flatnonzero(a == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = (ends - starts).astype(np.float64)
    kind = _CLASS[a]
    count = [np.add.reduceat((kind == k).view(np.uint8), starts, dtype=np.int64) for k in range(1, 9)]
    lower, upper, digit, space, plain, bang, symbol, high = count
    same = np.zeros(len(a), np.uint8)
    same[1:] = (a[1:] == a[:-1]) & (kind[1:] != _SPACE) & (a[1:] != 10)
    some = np.maximum(size, 1)
    words, distinct, repeated = np.empty(len(ends)), np.empty(len(ends)), np.empty(len(ends))
    i = 0
    for text in lines:
        seen: set[str] = set()
        for line in text:
            w = line.split()
            words[i], distinct[i], repeated[i] = len(w), len(set(w)), line in seen
            seen.add(line)
            i += 1
    letters = np.maximum(lower + upper + high, 1)
    last = a[np.maximum(ends - 1, 0)]
    f = np.stack(
        [
            np.ones(len(ends)),
            np.log1p(size) / 8,
            upper / letters,
            digit / some,
            space / some,
            plain / some,
            bang / some * 4,
            symbol / some * 4,
            high / some,
            np.add.reduceat(same, starts, dtype=np.int64) / some,
            repeated,
            distinct / np.maximum(words, 1),
            size / np.maximum(words, 1) / 10,
            (last == 46) & (size > 0),
            size == 0,
            np.log1p(words) / 6,
        ],
        axis=1,
    )
    return np.minimum(f, 4), size + 1, per_text


@dataclass
class LineField:
    """weights: own, previous line's and next line's features; stay: weights of good-good and bad-bad; curve: of the logistic map."""

    weights: np.ndarray
    stay: np.ndarray
    curve: np.ndarray

    def potentials(self, f: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        own, before, after = self.weights.reshape(3, FEATURES)
        e = f @ own
        inner = np.ones(len(f), bool)
        inner[np.cumsum(per_text) - per_text] = False  # lines with one before them in their text
        e[inner] += f[:-1][inner[1:]] @ before
        e[:-1][inner[1:]] += f[inner] @ after
        return e

    def messages(self, e: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of good from the lines up to each, and from those after it; all texts step together."""
        good, bad = self.stay
        order = np.argsort(-per_text, kind="stable")
        starts, n = (np.cumsum(per_text) - per_text)[order], per_text[order]
        a, b = e.copy(), np.zeros_like(e)
        active = np.searchsorted(-n, -np.arange(1, n[0] + 1), side="right") if len(n) else []
        for t in range(1, len(active)):
            at = starts[: active[t]] + t
            p = a[at - 1]
            a[at] += np.logaddexp(0, good + p) - np.logaddexp(bad, p)
        for t in range(len(active) - 1, 0, -1):
            at = starts[: active[t]] + t
            x = e[at] + b[at]
            b[at - 1] = np.logaddexp(0, good + x) - np.logaddexp(bad, x)
        return a, b

    def marginals(self, f: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        a, b = self.messages(self.potentials(f, per_text), per_text)
        return 1 / (1 + np.exp(-np.clip(a + b, -30, 30)))

    def quality(self, f: np.ndarray, size: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """Mean of the lines' marginals by their length."""
        starts = np.cumsum(per_text) - per_text
        p = self.marginals(f, per_text)
        return np.add.reduceat(p * size, starts) / np.add.reduceat(size, starts) if len(starts) else np.zeros(0)

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return self.probability(self.quality(*line_features(texts)))

    def probability(self, q: np.ndarray) -> np.ndarray:
        q = np.clip(q, 1e-4, 1 - 1e-4)
        return 1 / (1 + np.exp(-(self.curve[0] * np.log(q / (1 - q)) + self.curve[1])))


def fit(f: np.ndarray, size: np.ndarray, per_text: np.ndarray, good: np.ndarray, steps: int = STEPS) -> LineField:
    """Maximum likelihood with a small penalty; each line takes its document's label; Adam on the full gradient."""
    model = LineField(np.zeros(3 * FEATURES), np.zeros(2), np.array([1.0, 0.0]))
    if not len(per_text):
        return model
    y = np.repeat(good, per_text).astype(np.float64)
    inner = np.ones(len(f), bool)
    inner[np.cumsum(per_text) - per_text] = False
    second = np.flatnonzero(inner)
    # A long document counts as much as a short one.
    weight = np.repeat(1 / per_text, per_text)
    g1 = g2 = np.zeros(3 * FEATURES + 2)
    for step in range(1, steps + 1):
        e = model.potentials(f, per_text)
        a, b = model.messages(e, per_text)
        r = weight * (y - 1 / (1 + np.exp(-np.clip(a + b, -30, 30))))
        grad = np.zeros(3 * FEATURES + 2)
        grad[:FEATURES] = r @ f
        grad[FEATURES : 2 * FEATURES] = r[second] @ f[second - 1]
        grad[2 * FEATURES : 3 * FEATURES] = r[second - 1] @ f[second]
        left, right = a[second - 1], e[second] + b[second]
        both = np.stack([model.stay[0] + left + right, np.full(len(second), model.stay[1]), left, right])
        both = np.exp(both - np.logaddexp.reduce(both, axis=0)) if len(second) else both
        w2 = weight[second]
        grad[-2] = w2 @ ((y[second - 1] * y[second]) - both[0])
        grad[-1] = w2 @ (((1 - y[second - 1]) * (1 - y[second])) - both[1])
        theta = np.concatenate([model.weights, model.stay])
        grad = grad / len(per_text) - 1e-4 * theta
        g1, g2 = 0.9 * g1 + 0.1 * grad, 0.99 * g2 + 0.01 * grad * grad
        theta = theta + 0.1 * (g1 / (1 - 0.9**step)) / (np.sqrt(g2 / (1 - 0.99**step)) + 1e-8)
        model.weights, model.stay = theta[:-2], np.clip(theta[-2:], -3, 3)
    q = np.clip(model.quality(f, size, per_text), 1e-4, 1 - 1e-4)
    x = np.stack([np.log(q / (1 - q)), np.ones(len(q))])
    curve = np.array([1.0, 0.0])
    for _ in range(30):  # Newton steps on two weights, penalised towards (1, 0)
        p = 1 / (1 + np.exp(-np.clip(curve @ x, -30, 30)))
        g = x @ (good - p) - (curve - [1, 0])
        curve = curve + np.linalg.solve((x * (p * (1 - p) + 1e-9)) @ x.T + np.eye(2), g)
    model.curve = curve
    return model


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE_DOCS, lines: int = SAMPLE_LINES) -> LineField:
    """Fit on a bounded sample: the ``sample`` labelled rows whose id has the smallest hash (that many rows are
    broadcast to pick their texts), without documents of over ``lines`` lines. Ids of any type meet as text. Rows with
    a null id or label are left out. Without labelled rows every weight stays 0 and every score is 0.5."""
    picked = (
        labels.select(F.col(f"`{doc_id}`").cast("string").alias("_id"), F.col(f"`{label}`").cast("int").alias("_label"))
        .dropna()
        .groupBy("_id")
        .agg(F.max("_label").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(1)]
            out = []
            for t in texts:
                f, size, n = line_features([t])
                out.append((f.astype(np.float32).tobytes(), size.tobytes()) if n[0] <= lines else (b"", b""))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], ["id", "label", "f", "size"])

    # The sample's size is bounded by ``sample``.
    joined = docs.select(F.col(f"`{doc_id}`").cast("string").alias("_id"), F.col(f"`{text}`").alias("_text")).join(F.broadcast(picked), "_id")
    rows = joined.select("_id", "_text", "_label").mapInArrow(run, "id string, label int, f binary, size binary").orderBy("id").limit(sample).collect()
    rows = [r for r in rows if r["f"]]
    f = [np.frombuffer(r["f"], np.float32).reshape(-1, FEATURES) for r in rows]
    if not f:
        return fit(np.zeros((0, FEATURES)), np.zeros(0), np.zeros(0, int), np.zeros(0))
    return fit(np.concatenate(f).astype(np.float64), np.concatenate([np.frombuffer(r["size"]) for r in rows]), np.array([len(x) for x in f]), np.array([float(r["label"]) for r in rows]))


def _batches(b: pa.RecordBatch, column: int, chars: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """Slices of a batch's texts of about ``chars`` characters; a longer text stands alone."""
    start, held, size = 0, [], 0
    for i, t in enumerate(b.column(column)):
        t = t.as_py() or ""
        if held and size + len(t) > chars:
            yield start, held
            start, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield start, held


def score(docs: DataFrame, model: LineField, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if score >= threshold) for every row. A null or empty text is one
    empty line and is scored as such. Repeated rows and null ids stay; other columns are not read. Map only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, texts in _batches(b, 1):
                s = shared.value.score(texts)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts)), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: LineField, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all their columns as they are, whose text's score reaches ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(s):  # noqa: ANN001, ANN202
        import pandas as pd

        texts = [t or "" for t in s]
        return pd.Series(np.concatenate([shared.value.score(texts[i : i + 500]) for i in range(0, len(texts), 500)]) >= threshold) if texts else pd.Series([], dtype=bool)

    return docs.filter(good(F.col(f"`{text}`")))


def label_lines(docs: DataFrame, model: LineField, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, line (from 0), good (marginal probability) and text of every line."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            for start, texts in _batches(b, 1):
                f, _, n = line_features(texts)
                p = shared.value.marginals(f, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[start + i] for i, k in enumerate(n) for _ in range(k)], pa.int64()),
                        pa.array([j for k in n for j in range(k)], pa.int64()),
                        pa.array(p),
                        pa.array([line for t in texts for line in t.split("\n")], pa.string()),
                    ],
                    ["doc_id", "line", "good", "text"],
                )

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "doc_id long, line long, good double, text string")
