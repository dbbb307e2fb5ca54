"""Scores of the learned operators against plain Python over the same weights."""

import hashlib
import math
import re
import resource

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import common, quality, toxicity

MASK = (1 << 64) - 1


def mix(x):
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & MASK
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & MASK
    return x ^ x >> 33


def lower(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


def logistic(z):
    return 1 / (1 + math.exp(-z))


def toxic_score(weights, text):
    bag = {}
    for word in re.findall(rb"[^\x20\x09-\x0D]+", lower(text)):
        marked = b" " + word + b" "
        for n in toxicity.GRAMS:
            for i in range(len(marked) - n + 1):
                row = mix(int.from_bytes(marked[i : i + n], "little") * (2 * n - 1) & MASK) >> 64 - toxicity.BITS
                bag[row] = bag.get(row, 0) + 1
    total = sum(math.sqrt(c) for c in bag.values())
    return logistic(sum(float(weights[r]) * math.sqrt(c) / total for r, c in bag.items()) + float(weights[-1]))


def span_hash(raw):
    value = sum((mix(b + 1) | 1) * pow(common._BASE, i, 1 << 64) for i, b in enumerate(raw))
    return mix((value & MASK) + len(raw) & MASK)


def quality_score(weights, text):
    tokens = [span_hash(m) for m in re.findall(rb"[0-9a-z\x80-\xff]+|[^\x20\x09-\x0D0-9a-z\x80-\xff]+", lower(text))]
    rows = [t >> 64 - quality.BITS for t in tokens] + [mix(a * 3 + b & MASK) >> 64 - quality.BITS for a, b in zip(tokens[:-1], tokens[1:], strict=True)]
    total = math.sqrt(max(1, len(rows)))
    return logistic(sum(float(weights[r]) * math.sqrt(rows.count(r)) / total for r in set(rows)) + float(weights[-1]))


@pytest.mark.parametrize(("module", "score", "brute", "column"), [(toxicity, toxicity.score_toxicity, toxic_score, "toxic"), (quality, quality.score_quality, quality_score, "quality")])
def test_scores_equal_brute_force(spark, edge, module, score, brute, column):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(edge.select(F.col("doc_id") + 10**6, "text").toDF("doc_id", "text"))
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    weights, texts = module.fit(docs, labels), {r.doc_id: r.text for r in docs.filter("doc_id is not null and length(text) < 20000 or text is null").collect()}
    rows = [r for r in score(docs, labels).collect() if r.doc_id in texts]
    some = rows if column == "toxic" else rows[:60] + rows[-14:]
    for r in some:
        assert abs(r.score - brute(weights, texts[r.doc_id])) < 1e-4, r


def test_long_texts_are_read_in_passes(monkeypatch):
    text = " ".join(f"w{i * 7919 % 50021:x}\tA{i % 13}" for i in range(1_400_000))[: 16 << 20]
    batch = pa.RecordBatch.from_pylist([{"text": text}])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    rows, weights = toxicity.bags(batch)[0]
    grown = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before
    assert grown < 200 * 1024
    monkeypatch.setattr(toxicity, "SLICE_BYTES", 1 << 30)
    whole, all_weights = toxicity.bags(batch)[0]
    assert (rows == whole).all() and abs(weights - all_weights).max() < 1e-7


def test_sample_is_bounded(spark):
    """Rows that repeat a picked id don't widen the sample; nor do long texts."""
    docs = spark.createDataFrame([(i % 20, f"text {i} " * (1 + i % 3)) for i in range(400)] + [(21, "x" * 5000), (22, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(24)], "doc_id long, toxic int")
    known = toxicity.learning_rows(docs, labels, "toxic", 3, 1, 1000)
    rows = toxicity.sample(docs, known, {1: 50, 0: 50}, 1 << 20, 1000).collect()
    assert len({r.doc_id for r in rows}) == len(rows) and {r.doc_id for r in rows} <= set(range(20))
    few = toxicity.sample(docs, known, {1: 50, 0: 50}, 60, 1000).collect()
    assert 0 < len(few) < len(rows) and sum(len(r.text) for r in few) <= 60
    assert len(toxicity.sample(docs, known, {1: 2, 0: 3}, 1 << 20, 1000).collect()) == 5


def test_spans_longer_than_a_block():
    import numpy as np

    raw = bytes(i * i % 251 for i in range(3 * common._BLOCK + 17))
    starts, ends = np.array([0, 5, common._BLOCK - 1, common._BLOCK]), np.array([3, len(raw), common._BLOCK + 9, 2 * common._BLOCK])
    found = common.span_hashes(np.frombuffer(raw, np.uint8), starts, ends)
    assert found[0] == span_hash(raw[:3]) and found[2] == span_hash(raw[common._BLOCK - 1 : common._BLOCK + 9])
    for i in (1, 3):
        own = raw[starts[i] : ends[i]]
        assert int(found[i]) == mix(int.from_bytes(hashlib.blake2b(own, digest_size=8).digest(), "little") + len(own) & MASK)


def test_labels_of_absent_documents_change_nothing(spark):
    """100,000 labels of documents that aren't there, or have no text or a too long one, use up no bound and move no share."""
    rows = [(i, f"word{i % 9} {'bad' if i % 3 == 0 else 'good'} text {i}") for i in range(300)]
    docs = spark.createDataFrame([*rows, (400, None), (401, "x" * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int, quality int")
    absent = spark.range(400, 100_400).selectExpr("id as doc_id", "1 as toxic", "1 as quality")
    settings = toxicity.Settings(positives=60, negatives=120, longest=1000)
    assert (toxicity.fit(docs, labels, settings) == toxicity.fit(docs, labels.union(absent), settings)).all()
    settings = quality.Settings(good=60, poor=120, longest=1000)
    assert (quality.fit(docs, labels, settings) == quality.fit(docs, labels.union(absent), settings)).all()
