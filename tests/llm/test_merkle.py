"""The manifest against a plain fold over lists."""

import hashlib
import zlib

import pytest

from lectern.llm.merkle import merkle_manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    values = [row["doc_id"], row["source"], row["lang"], None if row["n_chars"] is None else row["n_chars"] + more, row["text"]]
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(hashes, arity):
    """(root, for each leaf its steps: digests to the left and to the right)."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    paths = []
    for place in range(len(hashes)):
        steps = []
        for level in levels[:-1]:
            first = place - place % arity
            steps.append(("".join(level[first:place]), "".join(level[place + 1 : first + arity])))
            place //= arity
        paths.append(steps)
    return levels[-1][0], paths


def plain(rows, arity):
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append(r)
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: sorted(trees[k], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))) for k in order}
    climbed = {k: climb([leaf(r) for r in own], arity) for k, own in trees.items()}
    root, upper = climb([climbed[k][0] for k in order], arity) if order else (None, [])
    out = []
    for k, above in zip(order, upper, strict=True):
        subroot, paths = climbed[k]
        for r, steps in zip(trees[k], paths, strict=True):
            tamper = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            h = leaf(r, 1 if tamper else 0)
            for a, b in steps + above:
                h = digest(a, h, b)
            out.append((r["doc_id"], leaf(r), subroot, root, digest(*[a + b for a, b in steps + above]), h, h == root))
    return out


def found(docs, arity):
    return [tuple(r) for r in merkle_manifest(docs, arity).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def key(row):
    return tuple(str(x) for x in row)


@pytest.mark.parametrize("arity", [2, 3])
def test_equals_plain_folds(spark, arity):
    rows = [(i, f"text {i}", ("en", "de", "é", None)[i % 4] if i % 5 else "en", None if i % 3 else "s", None if i % 11 == 0 else i) for i in range(1, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    ours = found(docs, arity)
    assert sorted(ours, key=key) == sorted(plain([r.asDict() for r in docs.collect()], arity), key=key)
    assert {r[-1] for r in ours} == {True, False}


@pytest.mark.parametrize("arity", [2, 3])
def test_edges(edge, arity):
    """Nulls, empty and very long texts, repeated ids and rows, columns with clashing names."""
    assert sorted(found(edge, arity), key=key) == sorted(plain([r.asDict() for r in edge.collect()], arity), key=key)


def test_one_row_and_none(spark, edge, empty):
    assert merkle_manifest(empty).count() == 0
    one = edge.filter("doc_id = 7")
    (row,) = merkle_manifest(one).collect()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == digest("")


def test_any_change_of_a_row_shows(spark, edge):
    """A manifest names the row whose fields were changed, and no other keeps its root."""
    from pyspark.sql import functions as F

    before = {r.doc_id: r for r in merkle_manifest(edge.dropDuplicates(["doc_id"])).collect()}
    changed = edge.dropDuplicates(["doc_id"]).withColumn("source", F.when(F.col("doc_id") == 8, F.lit("new")).otherwise(F.col("source")))
    after = {r.doc_id: r for r in merkle_manifest(changed).collect()}
    assert [k for k in before if before[k].leaf != after[k].leaf] == [8]
    assert not {r.root for r in before.values()} & {r.root for r in after.values()}
