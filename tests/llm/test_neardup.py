import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lectern.llm import neardup as N

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(docs):
    """docs: {id: text} -> {id: least id reachable}."""
    sets, holders, parent = {i: shingles(t) for i, t in docs.items()}, defaultdict(list), {i: i for i in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(docs):
        shared = Counter(j for s in sets[i] for j in holders[s])
        for j, n in shared.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            holders[s].append(i)
    return sets, {i: find(i) for i in docs}


def test_words_that_share_a_polynomial(spark):
    """Long words that a polynomial modulo 2^64 takes for one are two."""
    bits = [i.bit_count() % 2 for i in range(2048)]
    one, other = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    docs = spark.createDataFrame([(1, one), (2, other), (3, one), (4, f"{one} x y z w"), (5, f"{other} x y z w")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in N.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets, expected = brute({r.doc_id: r.text for r in docs.collect()})
    got = {r.doc_id: r for r in N.near_duplicates(docs).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), c, i == c) for i, c in expected.items()}


def test_chain_and_star_of_near_copies(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(80):
        own = list(base)
        for at in rng.choice(120, i % 9, replace=False):
            own[at] = f"e{i}x{at}"
        texts[i] = " ".join(own)
    for i in range(80, 100):  # a chain: each shifts a few words from the one before
        texts[i] = " ".join(f"c{k}" for k in range(4 * i, 4 * i + 60))
    _, expected = brute(texts)
    out = N.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in out} == expected
    assert len({expected[i] for i in range(80, 100)}) == 1 and len(set(expected.values())) < 60


def test_edge_cases(edge, empty):
    rows = N.near_duplicates(edge).collect()
    assert len(rows) == edge.count()
    got = {r.doc_id: r for r in rows}
    assert [got[i].component_id for i in (1, 2, 8)] == [1, 1, 1] and got[1].kept and not got[2].kept
    assert [(got[i].n_shingles, got[i].component_id, got[i].kept) for i in (3, 4, 5)] == [(0, i, True) for i in (3, 4, 5)]
    assert got[7].n_shingles == 1 and got[10].kept and got[None].n_shingles == 2
    assert N.near_duplicates(empty).count() == 0
    kept = N.drop_near_duplicates(edge)
    assert kept.columns == edge.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 4, 5, 6, 7, 9, 10]


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_estimate_is_corrected(share):
    rng = np.random.default_rng(1)
    n = 400
    both = rng.integers(1, 2**63, int(2 * n * share / (1 + share)), dtype=np.uint64)
    a, b = (np.unique(np.concatenate([both, rng.integers(1, 2**63, n - len(both), dtype=np.uint64)])) for _ in range(2))
    x, y = (N.registers(s, np.array([0, len(s)]), 512)[0] for s in (a, b))
    truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(N.estimate(np.array([(x == y).mean()]), np.array([len(a)]), np.array([len(b)]))[0] - truth) < 0.08


def test_null_id_among_copies(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(5, text), (None, text), (7, text), (9, text + " more"), (None, "alone with no id at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = N.near_duplicates(docs).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is not None} == {(5, 5, True), (7, 5, False), (9, 5, False)}
    assert len(got) == 5 and all(r.kept is None for r in got if r.doc_id is None)
    assert sorted(r.text for r in N.drop_near_duplicates(docs).collect() if r.doc_id is not None) == [text]
