"""Clashing names, repeated keys and wide vectors."""

import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import hamming, neardup, sharding, tokenfile, warc
from lectern.llm.common import cut, look_up

from .test_neardup import brute as groups
from .test_stores import brute
from .test_tokens import PATH


def test_shards_of_repeated_keys_and_clashing_names(spark, folder):
    rows = [(k % 7 if k % 5 else None, f"text {k} " * (k % 4), k, "p", 1) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, depth long, prefix string, hash int")
    sharding.write_shards(docs, f"{folder}/s", limit=100)
    back = spark.read.parquet(f"{folder}/s")
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, back.select("row.*").collect())) == sorted(map(key, docs.collect()))
    assert back.groupBy("row.doc_id").agg(F.count_distinct("depth", "prefix").alias("n")).filter("n > 1").isEmpty()


def test_all_dimensions_count(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.normal(size=150)
    rows = [(i, np.concatenate([base[:64], rng.normal(size=86)]).tolist()) for i in range(120)]  # alike in the first 64
    df = spark.createDataFrame([(i, e, 5, 6, "x") for i, e in rows], "vec_id long, embedding array<float>, query_id int, distance int, rank string")
    bits = {i: int("".join("1" if x > 0 else "0" for x in np.float32(e)), 2) for i, e in rows}
    expected = []
    for q in bits:
        if q % 20 == 0:
            near = sorted(((bits[q] ^ bits[j]).bit_count(), j) for j in bits if j != q)[:10]
            expected += [(q, n + 1, j, d) for n, (d, j) in enumerate(near)]
    assert sorted(tuple(r) for r in hamming.search(df).collect()) == sorted(expected)
    monkeypatch.setattr(hamming, "MOST_PIECES", 3)  # the pieces of large tables
    assert sorted(tuple(r) for r in hamming.search(df).collect()) == sorted(expected)
    small = [(i, e[:64]) for i, e in rows]
    df = spark.createDataFrame(small, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in hamming.search(df).collect()) == brute(small, 10, 20)


def test_record_ids_are_unique(spark, folder):
    pages = spark.createDataFrame([(1, "u", "x"), (1, "u", "y"), (None, None, None), (None, "v", "z" * 2000), (2, "v", "z" * 2000)], "page_id long, url string, html string")
    warc.write_warc(pages, f"file://{folder}/w")
    import glob

    ids = [r["warc-record-id"] for p in glob.glob(f"{folder}/w/*.warc.gz") for r in warc.read_records(open(p, "rb"))]
    assert len(ids) == 5 and len(set(ids)) == 5 and all(re.fullmatch(r"<urn:x-page:\d*:[-\w]+>", i) for i in ids)


def test_only_what_the_manifest_lists_is_read(spark, edge, folder):
    """Files of lost attempts lie beside the shards and archives and do no harm."""
    uri = f"file://{folder}/t"
    tokenfile.write_tokens(edge, PATH, uri, 3)
    want = sorted(tuple(r) for r in tokenfile.read_tokens(spark, uri).filter("doc_id is not null").collect())
    for name in ("shard-000000-lost.u2", "shard-000000-lost.mph"):
        with open(f"{folder}/t/{name}", "wb") as f:
            f.write(b"half")
    assert sorted(tuple(r) for r in tokenfile.read_tokens(spark, uri).filter("doc_id is not null").collect()) == want


def test_large_bucket_without_links(spark, monkeypatch):
    """Documents of one template share bands but are no near copies; a few of them are."""
    monkeypatch.setattr(neardup, "BLOCK", 64)
    rng = np.random.default_rng(2)
    frame = [f"t{i}" for i in range(60)]
    texts = {i: " ".join([*frame, *(f"d{i}x{k}" for k in range(18 + int(rng.integers(0, 3))))]) for i in range(300)}
    for i in range(300, 310):
        texts[i] = texts[i - 300] + " more"
    _, expected = groups(texts)
    got = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == expected


def test_pipeline_of_edge_cases(spark, edge, empty, folder):
    for name, docs in (("some", edge), ("none", empty)):
        docs.write.parquet(f"{folder}/{name}/documents.parquet")
        spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(1, 12)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/{name}/labels.parquet")
        spark.createDataFrame([(1, "no such passage is in any of them"), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{folder}/{name}/benchmark.parquet")
        rows = corpus_pipeline.run(spark, f"{folder}/{name}").collect()
        ids = [r.doc_id for r in rows if r.doc_id is not None]
        assert len(ids) == len(set(ids)) and set(ids) <= {r.doc_id for r in docs.collect()}
        assert all(r.n_tokens == 0 for r in rows if r.doc_id in (3, 4))
    assert not rows


def test_an_id_over_several_shards(spark, folder):
    """Half of the rows share an id; their copies are found in the order of the files."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame([(7 if k % 2 else k, f"text number {k}") for k in range(400)], "doc_id long, text string")
    uri = f"file://{folder}/t"
    manifest = tokenfile.write_tokens(docs, PATH, uri, 8).collect()
    assert max(r.docs for r in manifest) < 150 and sum(r["first"] == 7 or r["last"] == 7 for r in manifest) > 1
    rows = sorted(tokenfile.read_tokens(spark, uri).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in docs.collect())
    copies = [tokenfile.lookup(spark, uri, 7, k) for k in (0, 100, 199, 200)]
    texts = {tuple([*library.encode(r.text, add_special_tokens=False).ids, 0]) for r in docs.filter("doc_id = 7").collect()}
    assert copies[3] is None and len({tuple(c) for c in copies[:3]}) == 3 and all(tuple(c) in texts for c in copies[:3])
