"""Quality by hashed word n-gram logistic regression, learnt with follow-the-regularised-leader updates (operator 8).

Tokens are maximal runs of letters, digits and bytes over 127 (A-Z lowered), or of other marks; white space parts them.
Single tokens and pairs of neighbours are hashed to rows. A document is a sparse vector: the square roots of its rows'
counts, scaled to length 1. Its score is the logistic of a sparse dot product. The learner keeps, for each row, the sum
of gradients and of their squares, from which the weight follows in closed form with L1 and L2 terms.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, _SPACE, bucket_of, drop, map_batches, mix, sliced, span_hashes, text_column
from .toxicity import SPREAD, calibrate, learning_rows, read_examples, sample

BITS = 20

_KIND = np.full(256, 2, np.uint8)
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[_SPACE] = 0


@dataclass(frozen=True)
class Settings:
    """good and poor bound the training sample's rows, sample_bytes its texts, of which none is over longest; the rest are the learner's."""

    good: int = 4000
    poor: int = 4000
    sample_bytes: int = 64 << 20
    longest: int = 1 << 20
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    seed: int = 11


def vectors(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, values) of each text's sparse vector."""
    data, offsets = text_column(batch, "text")
    data = _LOWER[data]
    kind = _KIND[data]
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[offsets] = True
    bounds = np.flatnonzero(change)
    real = kind[bounds[:-1]] > 0
    starts, ends = bounds[:-1][real], bounds[1:][real]
    one = span_hashes(data, starts, ends)
    first = np.searchsorted(starts, offsets)
    two = mix(one[:-1] * np.uint64(3) + one[1:]) if len(one) > 1 else one[:0]
    shift = np.uint64(64 - BITS)
    one, two = (one >> shift).astype(np.int32), (two >> shift).astype(np.int32)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        rows, n = np.unique(np.concatenate([one[a:b], two[a : max(a, b - 1)]]), return_counts=True)
        out.append((rows, (np.sqrt(n) / max(1e-9, np.sqrt(n.sum()))).astype(np.float32)))
    return out


def _features(batches):
    for batch in sliced(batches, "text"):
        found = vectors(batch)
        rows, values = [r.tobytes() for r, _ in found], [v.tobytes() for _, v in found]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.binary()), pa.array(values, pa.binary())], names=["doc_id", "label", "rows", "values"])


def train(examples: list[tuple[int, np.ndarray, np.ndarray]], share: float, s: Settings) -> np.ndarray:
    """Calibrated weights of all rows, then the bias. share: label 1's share of all learning rows, which the sample's may differ from.

    A fifth of the sample isn't trained on and calibrates. With one class only, all weights are 0 and the bias tells the share.
    """
    label = np.array([y for y, _, _ in examples], np.int64)
    if len(set(label.tolist())) < 2:
        return np.append(np.zeros(1 << BITS), np.log((share + 1e-3) / (1 - share + 1e-3)))
    held = np.arange(len(examples)) % 5 == 4
    if len({*label[held]}) < 2 or len({*label[~held]}) < 2:
        held[:] = False
    rng, used = np.random.default_rng(s.seed), np.flatnonzero(~held)
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weight(rows: np.ndarray) -> np.ndarray:
        own = z[rows]
        return np.where(np.abs(own) <= s.l1, 0, -(own - np.sign(own) * s.l1) / ((s.beta + np.sqrt(n[rows])) / s.alpha + s.l2))

    for _ in range(s.epochs):
        for i in rng.permutation(used):
            rows, x = np.append(examples[i][1], 1 << BITS), np.append(examples[i][2], 1.0)
            w = weight(rows)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label[i]) * x
            z[rows] += g - (np.sqrt(n[rows] + g * g) - np.sqrt(n[rows])) / s.alpha * w
            n[rows] += g * g
    every = weight(np.arange((1 << BITS) + 1))
    weights, bias = every[:-1], every[-1]
    check = np.flatnonzero(held)
    if len(check):
        scale, shift = calibrate(np.array([weights[examples[i][1]] @ examples[i][2] for i in check]) + bias, label[check])
        weights, bias = weights * scale, bias * scale + shift
    own = np.clip(label.mean(), 1e-3, 1 - 1e-3)
    return np.append(weights, bias + np.log(max(share, 1e-3) / max(1 - share, 1e-3)) - np.log(own / (1 - own)))


def _trainer(share: float, s: Settings):
    def run(batches):
        weights = train(read_examples(batches, "rows", "values"), share, s)
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype(np.float32).tobytes()], pa.binary())], names=["model"])

    return run


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> np.ndarray:
    """The weights. It learns from rows whose crc32(doc_id) mod 5 is not 0; the sample is bounded by s and trained in one task."""
    known = learning_rows(docs, labels, "quality", 5, 0, s.longest)
    share = known.agg(F.avg(F.col("label").cast("double")).alias("share")).first().share
    examples = sample(docs, known, {1: s.good, 0: s.poor}, s.sample_bytes, s.longest)
    hashed = map_batches(examples.repartition(SPREAD), _features, "doc_id long, label int, rows binary, values binary")
    made = map_batches(hashed.repartition(1), _trainer(0.5 if share is None else share, s), "model binary")
    model = np.frombuffer(bytes(made.collect()[0].model), np.float32)
    drop(known)
    return model


def _scores(weights: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
    z = np.array([weights[rows] @ values for rows, values in vectors(batch)], np.float64) + float(weights[-1])
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _scorer(model):
    def run(batches):
        for batch in sliced(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(model.value, batch))], names=["doc_id", "score"])

    return run


def _filter(model, threshold: float):
    def run(batches):
        for batch in sliced(batches, "text"):
            yield batch.filter(pa.array(_scores(model.value, batch) >= threshold))

    return run


def score_quality(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    A null or empty text gets the score of the bias alone; a null doc_id is passed through with held_out null; long texts
    are read whole; repeated rows each get their row; without labels of both classes the score is the classes' share.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, settings))
    out = map_batches(docs.select("doc_id", "text"), _scorer(model), "doc_id long, score double")
    return out.select("doc_id", (bucket_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_poor(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, that score of at least the threshold. Nulls and empty texts as in score_quality()."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, settings))
    return map_batches(docs, _filter(model, threshold), docs.schema)
