"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) P(word | class, history). Both factors are softmaxes over hashed n-gram and
skip features of the three words before. The most frequent words are classes of their own; all others share classes
by their spelling's end, so every possible word has a class. Within such a class the most frequent words have weights
of their own and one more entry stands for all others, among which a word has its smoothed share: so the word factor
sums to one over an open vocabulary. With all weights 0 the model is the smoothed unigram one.

Training: one pass counts how often each feature stands before each outcome (the gradient's data term, over all
training rows). Then come synchronous updates: every task sums the model's expectation of the same counts over its
rows at one common set of weights, the sums are added over all tasks, and one update is made with the whole. The rows
of each update are a fixed share of all by hash of their text. So nothing depends on how the input is partitioned.

Texts are cut into words once to count these, and once more to be written as numbers that training and scoring read.
Scoring runs in numpy batches. Counts of frequent words are broadcast (a fixed bound); rarer words meet their counts
in a join by word, so no count is dropped. The weights are broadcast too: 256 bytes for each of MOST_BUCKETS at most.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import count_words, head_of, lower_ascii, mix, words

#: Words whose counts are broadcast, and words that are classes of their own.
HEAD_WORDS, SINGLES = 200_000, 31
#: Classes by spelling; with SINGLES and the end token there are 64.
SHAPES = 32
CLASSES = SINGLES + 1 + SHAPES
#: Words of a class by spelling that have weights of their own in the word factor; one entry more is for all others.
OWN = CLASSES - 1
#: Rows of the weights at least and at most; between, one for so many distinct words, so that the model grows with the
#: vocabulary as far as its memory has a bound.
BUCKETS, MOST_BUCKETS, WORDS_A_BUCKET = 1 << 14, 1 << 18, 256
#: Features of the class factor, and of the word factor.
CLASS_FEATURES, WORD_FEATURES = 4, 2
#: Tokens whose probabilities are held at a time, and characters or tokens of texts.
WINDOW, CHARS, TOKENS = 8192, 1_000_000, 1 << 17
#: Windows whose expectations are added up at once (40 MB), and rows of one key from which they are added alone.
WINDOWS, OFTEN = 8, 32
#: Updates: shares of the training rows in sixteenths, and step sizes. Counts added to a weight's and to a bucket's own.
STEPS, RATES, SMOOTH, RARE = (4, 5, 7), (0.7, 0.4, 0.3), 4.0, 5.0
_NEVER = np.float32(-1e9)


def tokens(text: str | None) -> list[str]:
    return words(lower_ascii(text)) if text else []


def _crc32(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


@functools.lru_cache(1 << 16)
def _shape_of(end: str) -> int:
    return _crc32(end) % SHAPES


def _shape(word: str) -> int:
    return _shape_of(word[-2:])


def _shape_column(word: Column) -> Column:
    return F.crc32(F.right(word, F.lit(2)).cast("binary")) % SHAPES


class _Index(dict):
    """word -> row of the arrays below; a word outside the head takes its spelling's row."""

    def __missing__(self, word: str) -> int:
        return self.rare + _shape(word)


@dataclass
class Vocabulary:
    """Arrays with a row for each head word, then one for each shape, then end and begin."""

    index: _Index
    logc: np.ndarray  # log10(count + 1); 0 for shapes, whose words' counts come by the join
    kind: np.ndarray  # class
    entry: np.ndarray  # within a class by spelling: own entry, or OWN for all others
    context: np.ndarray  # what features see; for shapes, where the word itself is not given
    class_base: np.ndarray  # natural log of each class's share
    word_base: np.ndarray  # natural log of each entry's share of its class; classes of one word have only entry OWN
    log_share: np.ndarray  # by class: log10 of the sum of count + 1 over the other words and an unknown one
    total: int
    distinct: int

    @property
    def buckets(self) -> int:
        return min(MOST_BUCKETS, max(BUCKETS, self.distinct // WORDS_A_BUCKET))

    @property
    def rare(self) -> int:
        return self.index.rare

    @classmethod
    def build(cls, head: list[tuple[str, int]], shape_sums: dict[int, int], texts: int, total: int, distinct: int) -> Vocabulary:
        """head: words by falling count. shape_sums: sum of count + 1 over all words of a shape that are no classes."""
        n = len(head)
        index = _Index({w: i for i, (w, _) in enumerate(head)})
        index.rare = n
        kind = np.array([i if i < SINGLES else SINGLES + 1 + _shape(w) for i, (w, _) in enumerate(head)] + [SINGLES + 1 + s for s in range(SHAPES)] + [SINGLES, SINGLES], dtype=np.int64)
        context = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w, _ in head] + [0] * SHAPES + [1, 2], dtype=np.uint64)
        context[context == 0] = np.uint64(1 << 33) + kind[context == 0].astype(np.uint64)
        counts = np.array([c for _, c in head] + [0] * SHAPES + [texts, 0], dtype=np.float64) + 1
        entry, mass, used = np.full(n + SHAPES + 2, OWN, dtype=np.int64), np.zeros((CLASSES, CLASSES)), [0] * CLASSES
        for i in range(SINGLES, n):
            k = kind[i]
            if used[k] < OWN:
                entry[i] = used[k]
                mass[k, used[k]] = counts[i]
                used[k] += 1
        share = np.array([1.0] * (SINGLES + 1) + [shape_sums.get(s, 0) + 1.0 for s in range(SHAPES)])
        mass[:, OWN] = np.maximum(1.0, share - mass[:, :OWN].sum(axis=1))
        weight = share.copy()
        weight[: min(n, SINGLES)] = counts[: min(n, SINGLES)]
        weight[SINGLES] = texts + 1
        weight[min(n, SINGLES) : SINGLES] = 0
        with np.errstate(divide="ignore"):
            class_base = np.maximum(np.log(weight / weight.sum()), _NEVER).astype(np.float32)
            word_base = np.maximum(np.log(mass / mass.sum(axis=1, keepdims=True)), _NEVER).astype(np.float32)
        return cls(index, np.log10(counts), kind, entry, context, class_base, word_base, np.log10(mass[:, OWN]), total, distinct)

    @functools.cached_property
    def by_class(self) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of an ordered pair of classes (the nearer one times 128 comes first), and of the class three before."""
        return tuple(_buckets(np.arange(n, dtype=np.uint64), i, self.buckets) for i, n in ((2, (CLASSES + 1) * 128), (3, CLASSES + 1)))

    def rows(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(rows of all tokens with an end after each text, tokens of each text)."""
        end = self.rare + SHAPES
        n = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        out = np.empty(int(n.sum()), dtype=np.int64)
        at = 0
        get = self.index.__getitem__
        for t in texts:
            out[at : at + len(t)] = np.fromiter(map(get, t), np.int64, len(t))
            at += len(t)
            out[at] = end
            at += 1
        return out, n

    def tail(self, rows: np.ndarray) -> np.ndarray:
        """Places of the words outside the head."""
        return np.flatnonzero((rows >= self.rare) & (rows < self.rare + SHAPES))

    def contexts(self, rows: np.ndarray, tail: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """What features see of each token: every word by its own hash, in the head or not (``seen``: those of ``tail``)."""
        out = self.context[rows]
        out[tail] = seen
        return out

    def stream(self, texts: list[list[str]] | Stream) -> Stream:
        if isinstance(texts, Stream):
            return texts
        rows, n = self.rows(texts)
        tail, seen = self.tail(rows), np.zeros(0, np.uint64)
        if len(tail):
            flat = [w for t in texts for w in (*t, "")]
            seen = np.fromiter((_crc32(flat[i]) for i in tail.tolist()), np.uint64, len(tail))
        return Stream(self, rows, n, self.contexts(rows, tail, seen))

    def streams(self, b: pa.RecordBatch) -> Iterator[tuple[int, Stream]]:
        """(first row, tokens) for slices of some TOKENS tokens of columns ``rows`` and ``seen``; a longer text stands alone."""
        columns = [b.column(b.schema.get_field_index(c)) for c in ("rows", "seen")]
        n = pc.binary_length(columns[0]).to_numpy().astype(np.int64) // 4
        ends, start = np.cumsum(n), 0
        while start < len(n):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] - n[start] + TOKENS, side="right")))
            rows, seen = (np.frombuffer(b"".join(x.slice(start, stop - start).to_pylist()), kind) for x, kind in zip(columns, (np.int32, np.uint32)))
            rows = rows.astype(np.int64)
            yield start, Stream(self, rows, n[start:stop], self.contexts(rows, self.tail(rows), seen))
            start = stop


@dataclass
class Stream:
    """The tokens of some texts, one text after the other."""

    vocabulary: Vocabulary
    rows: np.ndarray
    n: np.ndarray
    context: np.ndarray

    def __post_init__(self) -> None:
        begin = np.cumsum(self.n) - self.n
        self.place = np.arange(len(self.rows)) - np.repeat(begin, self.n)

    def windows(self) -> Iterator[slice]:
        return (slice(i, i + WINDOW) for i in range(0, len(self.rows), WINDOW))

    def features(self, window: slice) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of a window's tokens for the class factor: the word before, the word before that (skip), both as
        an ordered pair of classes, and the class three before (skip). And for the word factor, each with the
        token's own class: the word before, and the word before that. A text's beginning fills what is missing."""
        v, at = self.vocabulary, np.arange(*window.indices(len(self.rows)))
        begin = v.rare + SHAPES + 1
        seen, classes = [], []
        for k in (1, 2, 3):
            there = self.place[at] >= k
            back = np.where(there, at - k, 0)
            seen.append(np.where(there, self.context[back], v.context[begin]))
            classes.append(np.where(there, v.kind[self.rows[back]], CLASSES))
        own = v.kind[self.rows[at]].astype(np.uint64) << np.uint64(40)
        pair, third = v.by_class
        of = lambda i, key: _buckets(key, i, v.buckets)
        by_class = [of(0, seen[0]), of(1, seen[1]), pair[classes[0] * 128 + classes[1]], third[classes[2]]]
        return np.stack(by_class, axis=1), np.stack([of(4, seen[0] + own), of(5, seen[1] + own)], axis=1)


def _buckets(keys: np.ndarray, feature: int, buckets: int) -> np.ndarray:
    return (mix(keys * np.uint64(8) + np.uint64(feature + 0x2545F490)) % np.uint64(buckets)).astype(np.int64)


def logits(weights: np.ndarray, buckets: np.ndarray, base: np.ndarray, join: np.ufunc = np.add) -> np.ndarray:
    """Of every outcome for each token; base: of each outcome, or of each token and outcome. Updates move a weight by at
    most the sum of RATES, and the bases are logs of shares that sum to one, so exponentials stay far from overflow.
    With the exponentials of weights and base, and ``np.multiply``, those of the logits."""
    z, more = np.empty((2, len(buckets), weights.shape[1]), weights.dtype)
    # Buckets are in range; other modes would take a copy.
    np.take(weights, buckets[:, 0], axis=0, out=z, mode="clip")
    join(z, base, out=z)
    for k in range(1, buckets.shape[1]):
        np.take(weights, buckets[:, k], axis=0, out=more, mode="clip")
        join(z, more, out=z)
    return z


def factors(v: Vocabulary, weights: np.ndarray, stream: Stream, window: slice, bases: tuple[np.ndarray, np.ndarray] | None = None, join: np.ufunc = np.add) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The class factor and then the word factor of a window: (places in it, buckets, outcomes, logits of all
    outcomes). Words that are classes of their own have no word factor. bases, join: as for ``logits``."""
    class_base, word_base = bases or (v.class_base, v.word_base)
    rows = stream.rows[window]
    by_class, by_word = stream.features(window)
    kinds = v.kind[rows]
    yield np.arange(len(rows)), by_class, kinds, logits(weights, by_class, class_base, join)
    at = np.flatnonzero(kinds > SINGLES)
    if len(at):
        yield at, by_word[at], v.entry[rows[at]], logits(weights, by_word[at], word_base.take(kinds[at], axis=0), join)


def log_probabilities(v: Vocabulary, weights: np.ndarray, stream: Stream, odds: np.ndarray | None = None) -> np.ndarray:
    """log10 of each token's probability, but for the counts of words outside the head: those have count 0 here. odds: the
    exponentials of the weights, if they are known. No token's outcome has a share of 0, so every product is above 0."""
    kinds = v.kind[stream.rows]
    odds = np.exp(weights) if odds is None else odds
    bases = np.exp(v.class_base), np.exp(v.word_base)
    out = np.where((kinds > SINGLES) & (v.entry[stream.rows] == OWN), v.logc[stream.rows] - v.log_share[kinds], 0.0)
    for window in stream.windows():
        for places, _, y, p in factors(v, odds, stream, window, bases, np.multiply):
            chosen = p[np.arange(len(y)), y].astype(np.float64)
            out[window.start + places] += np.log10(chosen / p.sum(axis=1))
    return out


def _texts(b: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[list[str]]]]:
    """(first row, tokens of each text) for slices of some CHARS characters; a longer text stands alone."""
    start, held, size = 0, [], 0
    for i, t in enumerate(b.column(column)):
        t = t.as_py() or ""
        if held and size + len(t) > CHARS:
            yield start, held
            start, held, size = i, [], 0
        held.append(tokens(t))
        size += len(t)
    if held:
        yield start, held


def observed(v: Vocabulary, sums: np.ndarray, texts: list[list[str]] | Stream) -> None:
    """Add to ``sums`` (by bucket and outcome) how often each feature stands with each outcome."""
    stream, flat = v.stream(texts), sums.ravel()
    for window in stream.windows():
        rows = stream.rows[window]
        by_class, by_word = stream.features(window)
        at = np.flatnonzero(v.kind[rows] > SINGLES)
        for buckets, y in ((by_class, v.kind[rows]), (by_word[at], v.entry[rows[at]])):
            np.add.at(flat, (buckets * CLASSES + y[:, None]).ravel(), 1)


def add_rows(sums: np.ndarray, keys: np.ndarray, rows: np.ndarray) -> None:
    """sums[key] += row for all rows: the first of each key, then the second of each, and so on; keys of many rows alone."""
    # Numbers of 16 bits are sorted by radix.
    order = np.argsort(keys.astype(np.uint16), kind="stable") if len(sums) <= 1 << 16 else np.argsort(keys)
    sort = keys[order]
    first = np.flatnonzero(np.concatenate([[True], sort[1:] != sort[:-1]]))
    n = np.diff(np.append(first, len(sort)))
    falling = np.argsort(-n, kind="stable")
    first, n = first[falling], n[falling]
    many = int(np.searchsorted(-n, -OFTEN))
    for a, k in zip(first[:many].tolist(), n[:many].tolist()):
        sums[sort[a]] += rows.take(order[a : a + k], axis=0).sum(axis=0, dtype=np.float64)
    first, n = first[many:], n[many:]
    if len(first):
        held = rows.take(order[first], axis=0)
        for place in range(1, n[0]):
            more = int(np.searchsorted(-n, -place))
            held[:more] += rows.take(order[first[:more] + place], axis=0)
        sums[sort[first]] += held


def expected(v: Vocabulary, weights: np.ndarray, sums: np.ndarray, texts: list[list[str]] | Stream, odds: np.ndarray | None = None) -> None:
    """Add to ``sums`` what the model expects ``observed`` to be. odds: the exponentials of the weights, if they are known."""
    stream = v.stream(texts)
    odds = np.exp(weights) if odds is None else odds
    bases = np.exp(v.class_base), np.exp(v.word_base)
    windows = list(stream.windows())
    for i in range(0, len(windows), WINDOWS):
        some = windows[i : i + WINDOWS]
        held = [(np.empty((len(some) * WINDOW, k), np.int64), np.empty((len(some) * WINDOW, CLASSES), odds.dtype)) for k in (CLASS_FEATURES, WORD_FEATURES)]
        ends = [0, 0]
        for window in some:
            for of, (_, buckets, _, p) in enumerate(factors(v, odds, stream, window, bases, np.multiply)):
                at = slice(ends[of], ends[of] + len(p))
                held[of][0][at] = buckets
                np.divide(p, p.sum(axis=1, keepdims=True), out=held[of][1][at])
                ends[of] = at.stop
        for (buckets, p), end in zip(held, ends):
            for k in range(buckets.shape[1] if end else 0):
                add_rows(sums, buckets[:end, k], p[:end])


def expected_at_start(v: Vocabulary, sums: np.ndarray, texts: list[list[str]] | Stream) -> None:
    """``expected`` with all weights 0: each token has the shares of classes, and those of its class's entries."""
    stream, seen = v.stream(texts), np.zeros(len(sums), np.int64)
    kinds, words_of = [], []
    for window in stream.windows():
        by_class, by_word = stream.features(window)
        seen += np.bincount(by_class.ravel(), minlength=len(sums))
        kind = v.kind[stream.rows[window]]
        at = np.flatnonzero(kind > SINGLES)
        kinds.append(np.repeat(kind[at], WORD_FEATURES))
        words_of.append(by_word[at].ravel())
    share = lambda base: np.exp(base) / np.exp(base).sum(axis=-1, keepdims=True)
    at = np.flatnonzero(seen)
    sums[at] += seen[at, None] * share(v.class_base)
    both, n = np.unique(np.concatenate(words_of) * CLASSES + np.concatenate(kinds), return_counts=True)
    if len(both):
        add_rows(sums, both // CLASSES, share(v.word_base)[both % CLASSES] * n[:, None])


def update(weights: np.ndarray, data: np.ndarray, model: np.ndarray, rate: float) -> np.ndarray:
    """One synchronous step along the gradient data - model, each weight's scaled by its curvature (at most the counts
    themselves) and held back where a bucket is seldom met. model may be of a share of the rows: each bucket's sum says
    of how many."""
    n, seen = data.sum(axis=1, keepdims=True), model.sum(axis=1, keepdims=True)
    model = model * np.divide(n, seen, out=np.zeros_like(seen), where=seen > 0)
    step = (data - model) / (np.maximum(data, model) + SMOOTH) * (n / (n + RARE))
    return (weights + rate * np.where(seen > 0, step, 0)).astype(np.float32)


def _sum_over_tasks(coded: DataFrame, vocabulary, add, kind: type) -> np.ndarray:  # noqa: ANN001
    """The sums (by bucket and outcome) that ``add`` makes of every batch of coded texts, added over all tasks."""
    buckets = vocabulary.value.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((buckets, CLASSES), kind)
        for b in batches:
            for _, stream in vocabulary.value.streams(b):
                add(sums, stream)
        at = np.flatnonzero(sums.any(axis=1))
        for i in range(0, len(at), 10_000):
            some = at[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([x.tobytes() for x in sums[some].astype(np.float32)], pa.binary())], ["bucket", "v"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Row i of ``sums`` is of the i-th bucket met.
        where: dict[int, int] = {}
        sums = np.zeros((0, CLASSES))
        for b in batches:
            if not b.num_rows:
                continue
            keys, v = b.column(0).to_numpy(), np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32).reshape(-1, CLASSES)
            order = np.argsort(keys, kind="stable")
            met, first = np.unique(keys[order], return_index=True)
            at = np.array([where.setdefault(k, len(where)) for k in met.tolist()])
            if len(where) > len(sums):
                sums = np.concatenate([sums, np.zeros((max(len(where), 2 * len(sums)) - len(sums), CLASSES))])
            sums[at] += np.add.reduceat(v[order].astype(np.float64), first)
        yield pa.RecordBatch.from_arrays([pa.array(list(where), pa.int64()), pa.array([x.tobytes() for x in sums[: len(where)]], pa.binary())], ["bucket", "v"])

    local = coded.select("rows", "seen").mapInArrow(run, "bucket long, v binary")
    parts = max(1, int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = np.zeros((buckets, CLASSES))
    # As many rows as buckets, so MOST_BUCKETS at most.
    for r in local.repartition(parts, "bucket").mapInArrow(added, "bucket long, v binary").collect():
        out[r["bucket"]] = np.frombuffer(r["v"], np.float64)
    return out


def train(coded: DataFrame, vocabulary) -> np.ndarray:  # noqa: ANN001
    """Weights from all coded rows that have a share: the observed counts of all, then one update for each of STEPS with
    its share of them."""
    spark, v = coded.sparkSession, vocabulary
    learnt = coded.filter("share is not null")
    data = _sum_over_tasks(learnt, v, lambda sums, stream: observed(v.value, sums, stream), np.int64)
    weights, low = np.zeros((v.value.buckets, CLASSES), np.float32), 0
    for k, rate in zip(STEPS, RATES):
        some = learnt.filter((F.col("share") >= low) & (F.col("share") < low + k))
        if low:
            given = spark.sparkContext.broadcast((weights, np.exp(weights)))
            model = _sum_over_tasks(some, v, lambda sums, stream, w=given: expected(v.value, w.value[0], sums, stream, w.value[1]), np.float64)
            given.unpersist()
        else:
            model = _sum_over_tasks(some, v, lambda sums, stream: expected_at_start(v.value, sums, stream), np.float64)
        weights = update(weights, data, model, rate)
        low += k
    return weights


def _code(source: DataFrame, vocabulary, texts: int, total: int, distinct: int) -> DataFrame:  # noqa: ANN001
    """Each row of doc_id, text, share with an id, its tokens as rows of the vocabulary (32 bits each), the hashes that
    features see of words outside the head (``seen``), how often the text has each of these (``rest``), and from the head's
    counts alone how many tokens are known and the unigram score."""
    floor = math.log10(total + distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, at = vocabulary.value, TaskContext.get().partitionId() << 33
        known_end = texts > 0
        for b in batches:
            for start, lists in _texts(b, 1):
                stream = v.stream(lists)
                rows, n = stream.rows, stream.n
                begin = np.cumsum(n) - n
                known = np.add.reduceat(rows < v.rare, begin, dtype=np.int64) + known_end
                tail = v.tail(rows)
                owner = np.searchsorted(begin, tail, side="right") - 1
                # Of each text on its own, in order, so that a text's words follow each other.
                rest: Counter = Counter((k, lists[k][j]) for j, k in zip((tail - begin[owner]).tolist(), owner.tolist()))
                words_of = np.bincount(np.fromiter((k for k, _ in rest), np.int64, len(rest)), minlength=len(n))
                ids = at + np.arange(len(lists))
                at += len(lists)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids),
                        b.column(0).slice(start, len(lists)),
                        b.column(2).slice(start, len(lists)),
                        pa.array(n),
                        pa.array(known),
                        pa.array(np.add.reduceat(v.logc[rows], begin) - n * floor),
                        _binary(rows.astype(np.int32), n),
                        _binary(stream.context[tail].astype(np.uint32), np.bincount(owner, minlength=len(n))),
                        pa.MapArray.from_arrays(_offsets(words_of), pa.array([w for _, w in rest], pa.string()), pa.array(list(rest.values()), pa.int64())),
                    ],
                    ["row_id", "doc_id", "share", "n", "known", "base", "rows", "seen", "rest"],
                )

    return source.mapInArrow(run, "row_id long, doc_id long, share long, n long, known long, base double, rows binary, seen binary, rest map<string,long>")


def _offsets(n: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())


def _binary(x: np.ndarray, n: np.ndarray) -> pa.Array:
    """The bytes of each n following elements."""
    return pa.Array.from_buffers(pa.binary(), len(n), [None, _offsets(n * x.itemsize).buffers()[1], pa.py_buffer(x)])


def score(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Score every row's whole text with a model learnt from the rows where ``learn`` holds.

    Returns doc_id, n_tokens, n_known, train_tokens, base_score (add-one unigram) and score, both log10. A null
    or empty text is the end token alone. Without training rows every count is 0. Repeated rows and null ids
    stay; other columns are read only as far as ``learn`` needs them. ids are read as long. A very long text is held
    whole in one task (up to 2^29 tokens), its probabilities a window at a time.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "lm")
    learnt = docs.filter(learn).select(F.col(f"`{text}`").alias("text"))
    counts = scratch.save(count_words(learnt, "text", tokens), "counts")
    texts = learnt.count()
    head = sorted(((r[0], r[1]) for r in head_of(counts, HEAD_WORDS).collect()), key=lambda x: (-x[1], x[0]))
    top = [w for w, _ in head[:SINGLES]]
    sums = counts.groupBy(_shape_column(F.col("word")).alias("s"), F.col("word").isin(top).alias("single")).agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect()
    total, distinct = sum(r["n"] for r in sums) + texts, sum(r["k"] for r in sums) + (texts > 0)
    built = Vocabulary.build(head, {r["s"]: r["n"] + r["k"] for r in sums if not r["single"]}, texts, total, distinct)
    vocabulary = spark.sparkContext.broadcast(built)
    key = F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.when(learn, F.pmod(key, F.lit(sum(STEPS)))).alias("share"))
    coded = scratch.save(_code(source, vocabulary, texts, total, distinct), "coded")
    given = spark.sparkContext.broadcast(train(coded, vocabulary))
    kept = ["row_id", "doc_id", "n", "known", "base"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w = vocabulary.value, given.value
        odds = np.exp(w)
        for b in batches:
            for start, stream in v.streams(b):
                model = np.add.reduceat(log_probabilities(v, w, stream, odds), np.cumsum(stream.n) - stream.n)
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(start, len(model)) for i in range(len(kept))), pa.array(model)], [*kept, "model"])

    scored = scratch.save(coded.select(*kept, "rows", "seen").mapInArrow(run, "row_id long, doc_id long, n long, known long, base double, model double"), "scored")
    rare = (
        coded.select("row_id", F.explode("rest").alias("word", "n"))
        .join(counts.withColumnRenamed("n", "c"), "word")
        .groupBy("row_id")
        .agg(F.sum("n").alias("more_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more"))
    )
    whole = scored.join(rare, "row_id", "left")
    more = F.coalesce(F.col("more"), F.lit(0.0))
    return whole.select(
        "doc_id",
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )
