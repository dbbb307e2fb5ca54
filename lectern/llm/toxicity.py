"""Toxicity by subword-bag embeddings averaged into a linear softmax (operator 4).

A document is the bag of its words' byte n-grams (3 to 5 bytes of `<word>` with A-Z lowered), each hashed to a row of an
embedding table. Documents are averages of their rows; a linear softmax over two classes stands on top. Table and
softmax are trained together, in numpy. As the score is linear before the softmax, a trained model folds into one weight
a row: log-odds = bias + mean of the weights of the document's n-grams, so scoring reads each text once. The mean weighs
a distinct n-gram by the square root of its count, so that a long text's common n-grams don't drown a few rare ones. A
fifth of the sample, never trained on, calibrates the log-odds; they are then moved from the sample's share of toxic rows
to that of all learning rows, so a score means the same whether or not the sample's bounds bite.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _LOWER, _SPACE, SLICE_BYTES, binary_views, bucket_of, cut, drop, map_batches, mix, sliced, text_column

BITS = 18
GRAMS = (3, 4, 5)
#: Tasks that make the sample's bags.
SPREAD = 16
#: Bytes of a pass inside a text that is longer than a slice.
PASS_BYTES = 1 << 18

#: A-Z lowered, all white space as blank.
_FOLD = np.where(_SPACE, np.uint8(0x20), _LOWER)


@dataclass(frozen=True)
class Settings:
    """positives and negatives bound the training sample's rows, sample_bytes its texts, of which none is over longest; the rest are the learner's."""

    positives: int = 1500
    negatives: int = 3500
    sample_bytes: int = 64 << 20
    longest: int = 1 << 20
    dims: int = 8
    epochs: int = 10
    steps: int = 600
    batch: int = 64
    rate: float = 30.0
    seed: int = 7


def _rows_at(padded: np.ndarray, n: int):
    """(table rows, validity) of the n-grams at the first n places, one size of GRAMS after another."""
    space = _SPACE[padded]
    code, inner = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(max(GRAMS)):
        code |= padded[k : k + n].astype(np.uint64) << np.uint64(8 * k)
        if k >= 2:
            inner &= ~space[k - 1 : k - 1 + n]
        if k + 1 in GRAMS:
            yield (mix(code * np.uint64(2 * k + 1)) >> np.uint64(64 - BITS)).astype(np.int32), inner


def _weights(count: np.ndarray) -> np.ndarray:
    weight = np.sqrt(count, dtype=np.float32)
    return weight / max(1e-9, weight.sum())


def _long_bag(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bag of one long text, counted pass by pass in a table of all rows."""
    count = np.zeros(1 << BITS, np.int64)
    for at in range(-1, len(data), PASS_BYTES):
        n = min(PASS_BYTES, len(data) - at)
        part = data[max(0, at) : at + n + max(GRAMS)]
        padded = np.full(n + max(GRAMS), 0x20, np.uint8)
        padded[max(0, -at) : max(0, -at) + len(part)] = _FOLD[part]
        for rows, valid in _rows_at(padded, n):
            count += np.bincount(rows[valid], minlength=1 << BITS)
    rows = np.flatnonzero(count).astype(np.int32)
    return rows, _weights(count[rows])


def bags(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct table rows, weights that add to 1) of each text; both are empty without n-grams."""
    data, offsets = text_column(batch, "text")
    n = len(offsets) - 1
    if len(data) > SLICE_BYTES:
        return [_long_bag(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    padded = np.full(len(data) + n + 1 + max(GRAMS), 0x20, np.uint8)
    padded[np.arange(len(data)) + 1 + np.repeat(np.arange(n), np.diff(offsets))] = _FOLD[data]
    size = len(padded) - max(GRAMS)
    places = np.minimum(offsets + np.arange(n + 1), size)
    found = []
    for rows, valid in _rows_at(padded, size):
        found.append((rows[valid], np.concatenate([[0], np.cumsum(valid, dtype=np.int32)])[places].tolist()))
    out = []
    for i in range(n):
        own = np.sort(np.concatenate([rows[first[i] : first[i + 1]] for rows, first in found]))
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        out.append((own[starts], _weights(np.diff(np.append(starts, len(own))))))
    return out


def _features(batches):
    for batch in sliced(batches, "text"):
        found = bags(batch)
        ids, weights = [i.tobytes() for i, _ in found], [w.astype(np.float32).tobytes() for _, w in found]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(ids, pa.binary()), pa.array(weights, pa.binary())], names=["doc_id", "label", "ids", "weights"])


def calibrate(z: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """(scale, shift) of log-odds z by logistic regression with a weak prior towards (1, 0)."""
    x, theta = np.stack([z, np.ones_like(z)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -500, 500)))
        grad = x.T @ (p - label) + 0.1 * (theta - [1, 0])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), grad)
        theta -= step * min(1, 2 / max(1e-9, np.abs(step).max()))
    return max(float(theta[0]), 1e-3), float(theta[1])


def train(examples: list[tuple[int, np.ndarray, np.ndarray]], s: Settings) -> np.ndarray:
    """Calibrated weights of all rows, then the bias. examples: (label, rows, weights).

    Adagrad on the cross-entropy of a two-class softmax over the average of the rows; classes weigh alike. With one class
    only, or none, all weights are 0 and the bias tells the classes' shares.
    """
    label = np.array([y for y, _, _ in examples], np.int64)
    if len(set(label.tolist())) < 2:
        return np.append(np.zeros(1 << BITS), np.log((label.sum() + 0.5) / (len(label) - label.sum() + 0.5)))
    rng = np.random.default_rng(s.seed)
    head, bias = rng.normal(0, 1, (2, s.dims)), np.zeros(2)
    table, seen, seen_head = np.zeros((1 << BITS, s.dims)), np.full(1 << BITS, 1e-8), np.full((2, s.dims), 1e-8)
    held = np.arange(len(examples)) % 5 == 4
    if len({*label[held]}) < 2 or len({*label[~held]}) < 2:
        held[:] = False
    used = np.flatnonzero(~held)
    importance = np.where(label == 1, 0.5 / label[used].mean(), 0.5 / (1 - label[used].mean()))
    # a small sample is gone over more often, so that it gets as many steps
    epochs = max(s.epochs, -(-s.steps * s.batch // len(used)))
    for epoch in range(epochs):
        rate, order = s.rate * (1 - epoch / epochs), rng.permutation(used)
        for at in range(0, len(order), s.batch):
            some = order[at : at + s.batch]
            rows, share = np.concatenate([examples[i][1] for i in some]), np.concatenate([examples[i][2] for i in some])
            doc = np.repeat(np.arange(len(some)), [len(examples[i][1]) for i in some])
            own, where = np.unique(rows, return_inverse=True)
            bag = table[own][where] * share[:, None]
            mean = np.stack([np.bincount(doc, bag[:, d], len(some)) for d in range(s.dims)], 1)
            z = mean @ head.T + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), label[some]] -= 1
            p *= importance[some, None] / len(some)
            # the two classes' errors are opposite, so a row's gradient is one number times the difference of the head's rows
            pull, step = np.bincount(where, p[doc, 1] * share, len(own)), head[1] - head[0]
            seen[own] += pull**2
            table[own] -= (rate * pull / np.sqrt(seen[own]))[:, None] * step / (step @ step)
            grad = p.T @ mean
            seen_head += grad**2
            head -= 0.001 * rate * grad / np.sqrt(seen_head)
            bias -= 0.05 * rate * p.sum(0)
    weights, shift = table @ (head[1] - head[0]), bias[1] - bias[0]
    check = np.flatnonzero(held)
    if len(check):
        z = np.array([weights[examples[i][1]] @ examples[i][2] for i in check]) + shift
        scale, more = calibrate(z, label[check])
        weights, shift = weights * scale, shift * scale + more
    return np.append(weights, shift)


def moved(weights: np.ndarray, sample: float, share: float) -> np.ndarray:
    """weights with the bias moved from the sample's share of class 1 to its share of all learning rows; both shares lie between 0 and 1."""
    out = weights.copy()
    out[-1] += np.log(share / (1 - share)) - np.log(sample / (1 - sample))
    return out


def read_examples(batches, rows: str, values: str) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(label, rows, values) in the order of the ids, as views of the batches' own buffers."""
    found = []
    for b in batches:
        found += zip(b.column("doc_id").to_pylist(), b.column("label").to_pylist(), binary_views(b.column(rows), np.int32), binary_views(b.column(values), np.float32), strict=True)
    found.sort(key=lambda r: r[0])
    return [r[1:] for r in found]


def _trainer(s: Settings, share: float | None):
    def run(batches):
        examples = read_examples(batches, "ids", "weights")
        weights = train(examples, s)
        own = np.mean([y for y, _, _ in examples]) if examples else 0.0
        if share is not None and 0 < share < 1 and 0 < own < 1:
            weights = moved(weights, own, share)
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype(np.float32).tobytes()], pa.binary())], names=["model"])

    return run


def learning_rows(docs: DataFrame, labels: DataFrame, column: str, mod: int, held: int, longest: int) -> DataFrame:
    """(doc_id, label) of each id that isn't held out, has a label of 0 or 1 and a document whose text isn't null or over `longest` bytes; 1 where its labels differ. Written: bounds and counts are those of these rows."""
    known = labels.select("doc_id", F.col(column).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (bucket_of("doc_id", mod) != held))
    usable = docs.filter(F.octet_length("text") <= longest).select("doc_id")
    return cut(known.groupBy("doc_id").agg(F.max("label").alias("label")).join(usable, "doc_id", "left_semi"), "learning")


def sample(docs: DataFrame, known: DataFrame, most: dict[int, int], sample_bytes: int, longest: int) -> DataFrame:
    """(doc_id, text, label) of at most most[c] of the learning rows of each class c, those with the least hashed ids, up to sample_bytes of text.

    An id that has several rows gives one, with the least text.
    """
    some = [known.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for c, n in most.items()]
    picked = some[0].union(some[1])
    # picked has at most sum(most) rows of two numbers
    texts = docs.select("doc_id", "text").filter(F.octet_length("text") <= longest).join(F.broadcast(picked), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    # a window over the sample alone
    used = F.sum(F.octet_length("text").cast("long")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    return texts.withColumn("_used", used).filter(F.col("_used") <= sample_bytes).drop("_used")


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> np.ndarray:
    """The folded model. It learns from rows whose crc32(doc_id) mod 3 is not 1; the sample is bounded by s and trained in one task."""
    known = learning_rows(docs, labels, "toxic", 3, 1, s.longest)
    n = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    # unless a bound bites, the sample's own share is that of all learning rows
    bites = n.get(1, 0) > s.positives or n.get(0, 0) > s.negatives
    share = n.get(1, 0) / (n.get(1, 0) + n.get(0, 0)) if bites else None
    examples = sample(docs, known, {1: s.positives, 0: s.negatives}, s.sample_bytes, s.longest)
    bagged = map_batches(examples.repartition(SPREAD), _features, "doc_id long, label int, ids binary, weights binary")
    made = map_batches(bagged.repartition(1), _trainer(s, share), "model binary")
    model = np.frombuffer(bytes(made.collect()[0].model), np.float32)
    drop(known)
    return model


def _scores(weights: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
    z = np.array([weights[rows] @ values for rows, values in bags(batch)], np.float64) + float(weights[-1])
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _scorer(model):
    def run(batches):
        for batch in sliced(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(model.value, batch))], names=["doc_id", "score"])

    return run


def _filter(model, threshold: float):
    def run(batches):
        for batch in sliced(batches, "text"):
            yield batch.filter(pa.array(_scores(model.value, batch) < threshold))

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    A null or empty text gets the score of the bias alone; a null doc_id is passed through with held_out null; long texts
    are read whole; repeated rows each get their row; without labels of both classes the score is the classes' share.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, settings))
    out = map_batches(docs.select("doc_id", "text"), _scorer(model), "doc_id long, score double")
    return out.select("doc_id", (bucket_of("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, that score under the threshold. Nulls and empty texts as in score_toxicity()."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, settings))
    return map_batches(docs, _filter(model, threshold), docs.schema)
