import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import bpe, decontaminate, langid, neardup, quality, toxicity

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels", "benchmark")}


def accuracy(scored, labels, column):
    rows = scored.join(labels.filter(F.col(column).isNotNull()).select("doc_id", column), "doc_id").filter("held_out").collect()
    return np.mean([r.predicted == r[column] for r in rows]), np.mean([r[column] == 1 for r in rows])


def test_toxicity_holds_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    scored = toxicity.score_toxicity(docs, labels)
    rows = scored.join(labels.filter("toxic is not null"), "doc_id").filter("held_out").collect()
    bad, good = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert np.mean([x > y for x in bad for y in good]) > 0.9
    caught, blamed = sum(x >= 0.7 for x in bad), sum(y >= 0.7 for y in good)
    assert caught > 0.4 * len(bad) and blamed < 0.02 * len(good)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_subwords_reach_unseen_spellings():
    import pyarrow as pa

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abdegilmnoprstu") for _ in range(5))
    text = lambda bad: " ".join([word() for _ in range(20)] + ([f"zorkq{word()}"] if bad else []))
    make = lambda n: [(k % 2, text(k % 2)) for k in range(n)]
    bags = lambda rows: [(y, *b) for (y, _), b in zip(rows, toxicity.bags(pa.RecordBatch.from_pylist([{"text": t} for _, t in rows])), strict=True)]
    weights = toxicity.train(bags(make(400)), toxicity.Settings())
    right = [(weights[i] @ w + weights[-1] > 0) == (y == 1) for y, i, w in bags(make(200))]
    assert np.mean(right) > 0.9


def test_quality_holds_out(tables):
    right, share = accuracy(quality.score_quality(tables["documents"], tables["labels"]), tables["labels"], "quality")
    assert right > 0.9 and right > share


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality.score_quality])
def test_scores_of_edge_cases(spark, edge, empty, labels, score):
    for own in (labels, labels.limit(0)):
        rows = score(edge, own).collect()
        assert len(rows) == edge.count() and all(0 <= r.score <= 1 for r in rows)
        assert all((r.held_out is None) == (r.doc_id is None) for r in rows)
    assert score(empty, labels).count() == 0


@pytest.mark.parametrize("drop", [toxicity.drop_toxic, quality.drop_poor])
def test_filters_keep_columns(edge, empty, labels, drop):
    assert drop(edge, labels).columns == edge.columns and drop(empty, labels.limit(0)).count() == 0


def test_languages(tables, edge, empty):
    rows = langid.identify_languages(tables["documents"]).join(tables["documents"].select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows if r.held_out]) > 0.97
    got = {r.doc_id: r for r in langid.identify_languages(edge).collect()}
    assert [got[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3 and got[3].score == 0 and got[3].rejected
    assert got[7].lang_pred == "en" and got[None].held_out is None
    assert langid.identify_languages(empty).count() == 0
    assert {r.lang_pred for r in langid.identify_languages(edge.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def edited(rng, text, n):
    s = list(text)
    for _ in range(n):
        at = rng.randrange(len(s))
        kind = rng.randrange(3)
        s[at : at + (kind != 1)] = [] if kind == 2 else [rng.choice("etaoinshr d")]
    return "".join(s)


def test_contamination_finds_planted_items(spark, tables):
    rng = random.Random(4)
    items = {r.item_id: r.text for r in tables["benchmark"].collect()}
    docs = [r for r in tables["documents"].collect() if not any(t in r.text for t in items.values())][:200]
    planted, rows = set(), []
    for k, (i, text) in enumerate(items.items()):
        host = docs[k % len(docs)].text
        cut = host.find(" ", len(host) // 2)
        rows.append((k, f"{host[:cut]} {edited(rng, text, len(text) * (k % 3) // 40)} {host[cut:]}"))
        planted.add((k, i))
    rows += [(1000 + k, d.text) for k, d in enumerate(docs)]
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), tables["benchmark"]).collect()}
    assert len(planted & found) >= 0.95 * len(planted)
    assert not {d for d, _ in found} & {r[0] for r in rows if r[0] >= 1000}


def test_edit_distance_equals_table():
    rng = random.Random(1)

    def table(a, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(a, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
            row = new
        return min(row)

    for _ in range(300):
        a, t = (bytes(rng.choice(b"abc") for _ in range(rng.randint(k, 20))) for k in (1, 0))
        assert decontaminate.least_distance(a, t, 99)[0] == table(a, t)


def test_contamination_edge_cases(spark, edge, empty):
    items = spark.createDataFrame([(1, "One  TWO three four"), (2, None), (3, ""), (4, " "), (1, "one two three four"), (5, "word " * 30), (6, "text")], "item_id long, text string")
    rows = decontaminate.contaminated(edge, items).collect()
    hits = {(r.doc_id, r.item_id) for r in rows}
    assert {(1, 1), (2, 1), (8, 1), (6, 5), (None, 6)} <= hits and not {i for _, i in hits} & {2, 3, 4}
    assert sum(r.doc_id == 1 and r.item_id == 1 for r in rows) == 2
    assert decontaminate.contaminated(empty, items).count() == 0 and decontaminate.contaminated(edge, items.limit(0)).count() == 0
    assert decontaminate.decontaminated(edge, items).columns == edge.columns


def test_pipeline_equals_its_stages(spark):
    """Each stage's rows, worked out from the operators' own reports, whose tests compare them with brute force."""
    tables = {n: spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "labels", "benchmark")}
    docs, labels, path = tables["documents"], tables["labels"], corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "neardup", "decontamination", "bpe"]
    steps = [
        lambda d: {r.doc_id for r in toxicity.score_toxicity(d, labels).filter("predicted = 0").collect()},
        lambda d: {r.doc_id for r in quality.score_quality(d, labels).filter("predicted = 1").collect()},
        lambda d: {r.doc_id for r in neardup.near_duplicates(d).filter("kept").collect()},
        lambda d: {r.doc_id for r in d.collect()} - {r.doc_id for r in decontaminate.contaminated(d, tables["benchmark"]).collect()},
    ]
    for (_, stage), step in zip(corpus_pipeline.STAGES, steps, strict=False):
        expected, docs = step(docs), corpus_pipeline.cut(stage(spark, docs, SMALL))
        assert docs.columns == tables["documents"].columns and {r.doc_id for r in docs.collect()} == expected
    last = sorted(tuple(r) for r in bpe.code_documents(docs, path).collect())
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SMALL).collect()) == last and last


def test_toxicity_keeps_its_meaning_when_the_sample_is_bounded(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    rate = lambda s: toxicity.score_toxicity(docs, labels, s).agg(F.avg("predicted")).first()[0]
    assert abs(rate(toxicity.Settings()) - rate(toxicity.Settings(positives=300, negatives=300))) < 0.02


def test_log_odds_move_to_the_real_share():
    out = toxicity.moved(np.array([0.5, 0.0]), 0.5, 0.1)
    assert out[0] == 0.5 and abs(1 / (1 + np.exp(-out[1])) - 0.1) < 1e-9
