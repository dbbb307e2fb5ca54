import random
import types

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import decontaminate as D

SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])


def found(docs, items):
    """(doc, item, distance) of rows of one batch."""
    shared = types.SimpleNamespace(value=D.Items.of(items))
    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "text": t} for i, t in docs], schema=SCHEMA)
    return {(r["doc_id"], r["item_id"], r["distance"]) for b in D._finder(shared)(iter([batch])) for r in b.to_pylist()}


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n))


def edited(rng, text, n):
    s = list(text)
    for at in rng.sample(range(len(s)), n):
        s[at] = "#"
    return "".join(s)


def test_rows_before_do_not_matter():
    rng = random.Random(8)
    items = [(k, words(rng, 18)) for k in range(60)]
    docs = []
    for k, text in items:
        docs.append((1000 + k, words(rng, 60)))
        docs.append((k, f"{edited(rng, text, len(text) * 6 // 100)} {words(rng, 20)}"))
    docs += [(2000 + k, f"{words(rng, 20)} {edited(rng, text, len(text) * 6 // 100)}") for k, text in items]
    alone = set().union(*(found([d], items) for d in docs))
    together = found(docs, items)
    assert alone == together and len(together) > 0.9 * 120


def test_long_items_without_their_head():
    rng = random.Random(9)
    items = [(k, words(rng, 150)) for k in range(20)]
    docs = [(k, f"{words(rng, 30)} {text[len(text) // 5 :]} {words(rng, 30)}") for k, text in items]
    assert {(d, i) for d, i, _ in found(docs, items)} == {(k, k) for k, _ in items}


def test_items_edited_to_the_limit():
    rng = random.Random(10)
    items = [(k, words(rng, 40)) for k in range(60)]
    docs = [(k, f"{words(rng, 30)} {edited(rng, text, len(text) // 5)} {words(rng, 30)}") for k, text in items]
    got = {(d, i) for d, i, _ in found(docs, items)}
    assert got <= {(k, k) for k, _ in items} and len(got) >= 0.85 * 60


@pytest.mark.parametrize("size", [20, 40, 47, 48, 55, 60, 71, 72, 80, 95, 96, 110, 143, 144, 160, 223, 224, 260])
def test_recall_of_each_length(size):
    """Items of each length with as many substitutions as are assured for it."""
    rng, n = random.Random(size), 100
    items = [(k, words(rng, 60)[:size].strip().ljust(size, "x")) for k in range(n)]
    docs = [(k, f"{words(rng, 20)} {edited(rng, text, int(size * D.assured_edits(size)))} {words(rng, 20)}") for k, text in items]
    got = {(d, i) for d, i, _ in found(docs, items)}
    assert got <= {(k, k) for k, _ in items} and len(got) >= 0.95 * n, len(got)


def test_distances_side_by_side():
    rng = random.Random(1)
    some = [(bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 90))), bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 150)))) for _ in range(600)]
    assert D.least_distances(some) == [D.least_distance(i, t, 0) for i, t in some]


def test_short_items_edited():
    rng = random.Random(11)
    items = [(k, words(rng, 8)[: rng.randint(12, 47)].strip()) for k in range(60)]
    docs = [(k, f"{words(rng, 30)} {edited(rng, text, len(text) // 5)} {words(rng, 30)}") for k, text in items]
    docs += [(100 + k, edited(rng, text, len(text) // 5)) for k, text in items]
    got = {(d, i) for d, i, _ in found(docs, items)}
    assert {(k + far, k) for k, _ in items for far in (0, 100)} <= got
    truth = {(d, i) for d, t in docs for i, x in items if D.least_distance(x.encode(), t.encode(), 0)[0] <= len(x) // 5}
    assert got == truth


def test_text_without_blanks():
    rng = random.Random(12)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 800)]
    run = lambda n: "".join(rng.choice(letters) for _ in range(n))
    items = [(k, run(60)) for k in range(40)]
    docs = [(k, run(100) + text + run(100)) for k, text in items]
    docs += [(100 + k, run(50) + text[:20] + "x" + text[21:40] + text[42:] + run(70)) for k, text in items]
    docs += [(200 + k, run(300)) for k in range(40)]
    got = found(docs, items)
    assert {(k, k, 0) for k, _ in items} <= got
    assert {(d % 100, i) for d, i, _ in got} == {(k, k) for k, _ in items} and len(got) >= 40 + 38


def test_equals_all_distances():
    """Every (document, item) distance, worked out one by one: no pair beyond the limit is reported, and at least 95 in 100 within it are."""
    rng = random.Random(13)
    items = [(k, words(rng, rng.randint(5, 60))) for k in range(40)]
    docs = []
    for k, text in items:
        for share in (0, 5, 10, 15, 19):
            docs.append((len(docs), f"{words(rng, 20)} {edited(rng, text, len(text) * share // 100)} {words(rng, 20)}"))
    docs += [(len(docs) + k, words(rng, 60)) for k in range(40)]
    truth = {}
    for d, text in docs:
        for i, item in items:
            distance = D.least_distance(item.encode(), text.encode(), 0)[0]
            if distance <= int(D.MAX_EDITS * len(item)):
                truth[d, i] = distance
    got = {(d, i): n for d, i, n in found(docs, items)}
    assert got.keys() <= truth.keys() and len(got) >= 0.95 * len(truth)
    assert all(truth[p] == n for p, n in got.items())


def test_columns_with_clashing_names(spark, edge):
    docs = edge.withColumns({"item_id": F.lit("x"), "distance": F.lit("y")})
    items = spark.createDataFrame([(1, "one two three four", 5)], "item_id long, text string, doc_id int")
    rows = D.contaminated(docs, items).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in rows} == {(1, 1, 0), (2, 1, 0), (8, 1, 0)}
    kept = D.decontaminated(docs, items)
    assert kept.columns == docs.columns and kept.filter("doc_id in (1, 2, 8)").isEmpty() and kept.count() == docs.count() - 4


def test_text_that_repeats_itself():
    """Every window of such a text meets every window of such an item; it must not cost that many looks."""
    import time

    began = time.time()
    got = found([(1, "word " * 60_000), (2, "la la " * 20_000 + "end"), (3, "x" * 100_000)], [(7, "word " * 30), (8, "la " * 60), (9, "x" * 300)])
    assert {(d, i) for d, i, _ in got} == {(1, 7), (2, 8), (3, 9)} and time.time() - began < 60
