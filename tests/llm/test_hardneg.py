"""Hard negatives against all products, over one page and many, with ties, copies and unusual rows."""

import math

import numpy as np
import pytest

from lectern.llm import hardneg
from lectern.llm.hardneg import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k=5, step=100):
    known = {}
    for vec_id, embedding, label in rows:
        if vec_id is None or label is None or embedding is None or any(x is None or not math.isfinite(x) for x in embedding):
            continue
        own = ((label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in embedding])
        known[vec_id] = min(known.get(vec_id, own), own)
    out = []
    for a, (label, q) in known.items():
        if a % step:
            continue
        scores = sorted((-sum(x * y for x, y in zip(q, v, strict=False)), b, c == label) for b, (c, v) in known.items() if b != a)
        for ps, p, _ in [s for s in scores if s[2]][:k]:
            ps = -ps
            hard = [(-s, n) for s, n, same in scores if not same and 80 * ps <= -100 * s <= 100 * ps]
            out += [(a, p, r + 1, n, ps, s) for r, (s, n) in enumerate(hard[:k])]
    return sorted(out)


def found(spark, rows, schema=SCHEMA):
    return sorted(tuple(r) for r in hard_negatives(spark.createDataFrame(rows, schema)).collect())


@pytest.fixture
def small_pages(monkeypatch):
    monkeypatch.setattr(hardneg, "PAGE", 40)


def vectors(n, width, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    return [(i, (centres[i % 6] + spread * rng.normal(size=width)).astype(np.float32).tolist(), int(rng.integers(4))) for i in range(n)]


@pytest.mark.parametrize(("width", "spread"), [(3, 0.2), (16, 1.0)])
def test_equals_all_products(spark, small_pages, width, spread):
    rows = vectors(700, width, 1, spread)
    ours = found(spark, rows)
    assert ours == plain(rows) and len({r[0] for r in ours}) == 7


def test_copies_and_ties(spark, small_pages):
    """A third of all rows have one vector, others differ in one step, so ids decide; anchors are among the copies."""
    rows = [(i, [1.0, 0.5, float(i % 3 == 0 and (i // 100) % 2) / 64], i % 5 % 3) if i % 3 else (i, [1.0, 0.5, 0.25], i % 2) for i in range(600)]
    ours = found(spark, rows)
    assert ours == plain(rows) and ours


def test_unusual_rows(spark):
    """Nulls anywhere, no or non-finite components, repeated ids, negative and zero scores, shorter vectors."""
    rows = vectors(150, 4, 2)
    rows += [(None, [1.0] * 4, 1), (200, None, 1), (201, [1.0, None, 0.0, 0.0], 1), (202, [float("nan")] * 4, 1), (203, [float("inf")] * 4, 1), (204, [1.0] * 4, None)]
    rows += [(300, [0.0] * 4, 1), (301, [], 1), (302, [0.5], 2), (400, [-1.0] * 4, 3), (5, [2.0] * 4, 0), (5, [2.0] * 4, 0), (0, [3.0] * 4, 1), (-100, [1.0] * 4, 2)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, [(100, [1.0], 1)]) == [] and found(spark, []) == []


def test_clashing_columns_and_large_components(spark):
    rows = [(i, [30_000.0 * (i % 7), float(i), 9.5], i % 2) for i in range(101)]
    ours = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA + ", entry string, q int, ids int")
    assert sorted(tuple(r) for r in hard_negatives(ours).collect()) == plain(rows)
    with pytest.raises(ValueError, match="exact"):
        found(spark, [(1, [1e30], 1)])


def test_queue_opens_few_boxes():
    """In three dimensions most leaves are pruned: below the k-th score, or outside of the range."""
    rng = np.random.default_rng(3)
    rows = rng.integers(-300, 300, (20_000, 3))
    rows = rows[hardneg.packed_order(rows)].astype(np.float64)
    page = hardneg.Page(rows, np.zeros(len(rows), np.int64), np.arange(len(rows)))
    opened = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            opened.append(at)
            return np.asarray(self)[at]

    page.labels = page.labels.view(Counted)
    query = np.array([[200.0, -100.0, 50.0]])
    scores = (rows @ query[0]).astype(np.int64)
    for high, low in ((float(-hardneg.NO_SCORE), float(hardneg.NO_SCORE + 1)), (3000.0, 2990.0)):
        opened.clear()
        best = hardneg.seek(page, query, np.zeros(1, np.int64), True, np.zeros(1, np.int64), np.array([high]), np.array([low]), 5)
        order = sorted((-s, i) for i, s in enumerate(scores) if low <= s <= high)[:5]
        assert [(-int(s), int(i)) for s, i in zip(best.score[0], best.id[0], strict=True)] == order
        assert len(opened) < len(rows) / hardneg.LEAF / 4
