"""Removal of repeated text against a plain pass over all windows, and the order of suffixes against sorting."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import suffixdedup, suffixes
from lectern.llm.suffixdedup import without_repeats


def plain(rows):
    """Result of each (id, text); rows that share an id come in the order of their texts' hashes, null ids last."""
    seen, out = set(), {}
    texts = {(i, t or "") for i, t in rows}
    for i, t in sorted(texts, key=lambda x: (x[0] is None, x[0] or 0, hashlib.sha256(x[1].encode()).hexdigest()[:15])):
        raw = t.encode()
        gone = bytearray(len(raw))
        for a in range(len(raw) - 99):
            if raw[a : a + 100] in seen:
                gone[a : a + 100] = b"\1" * 100
            else:
                seen.add(raw[a : a + 100])
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        out[i, t] = (i, len(raw), sum(gone), sum(1 for a, g in enumerate(gone) if g and not (a and gone[a - 1])), hashlib.sha256(kept).hexdigest())
    return sorted((str(out[i, t or ""]) for i, t in rows))


def found(docs):
    return sorted(str(tuple(r)) for r in without_repeats(docs).collect())


def texts(n, seed, alphabet="abcdefghij klmnop"):
    """Documents that share passages, with edits and shifts, beside text of their own."""
    rng = random.Random(seed)
    own = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    passages = [own(rng.randrange(90, 700)) for _ in range(12)]
    out = []
    for i in range(n):
        parts = [own(rng.randrange(0, 150))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(0, 60)
            p = p[a : len(p) - rng.randrange(0, 60)]
            if rng.random() < 0.3:
                k = rng.randrange(len(p))
                p = p[:k] + "Ж" + p[k + 1 :]
            parts += [p, own(rng.randrange(0, 40))]
        out.append((i * 3 % n if n % 3 else i, "".join(parts)))
    return out


@pytest.mark.parametrize(("group", "part", "gathered"), [(2048, 1 << 19, 1 << 19), (3, 500, 40)])
def test_equals_all_windows(spark, monkeypatch, group, part, gathered):
    """With production sizes, and with sizes at which anchors have many shares and texts many parts."""
    monkeypatch.setattr(suffixdedup, "GROUP", group)
    rows = texts(200, 1)
    if group == 3:
        monkeypatch.setattr(suffixdedup, "PART", part)
        batches = lambda: _batches(rows, 7)
        tables = list(_with(batches, gathered, monkeypatch))
        assert sum(t.num_rows for t in tables)  # parts and early settling in the task's own code
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(docs) == plain(rows)


def _batches(rows, n):
    import pyarrow as pa

    for a in range(0, len(rows), n):
        ids, own = zip(*rows[a : a + n], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([0] * len(ids), pa.int64()), pa.array(own)], names=["did", "dup", "text"])


def _with(batches, gathered, monkeypatch):
    monkeypatch.setattr(suffixdedup, "GATHERED", gathered)
    return suffixdedup._stretch_rows(batches())


def test_parts_of_long_texts(monkeypatch):
    """A text cut into parts has the windows of the whole one, each once."""
    monkeypatch.setattr(suffixdedup, "PART", 300)
    rows = [(1, texts(30, 5)[3][1] * 9), (2, "short")]
    windows = [(r["did"], r["start"] + k) for b in suffixdedup._stretch_rows(_batches(rows, 1)) for r in b.to_pylist() for k in range(r["size"])]
    assert sorted(windows) == [(1, k) for k in range(len(rows[0][1].encode()) - 99)]


def test_edges(spark, edge, empty):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    assert found(edge) == plain(rows)
    assert without_repeats(empty).count() == 0


def test_runs_periods_ties_and_repeated_rows(spark):
    long = "".join(random.Random(2).choice("abcd ") for _ in range(250))
    rows = [(5, "x" * 1000), (6, "x" * 99), (7, "x" * 100), (8, "xy" * 300), (9, "yx" * 60), (4, long), (4, long), (4, long + "!"), (None, long), (None, "q" + long), (3, "\0" * 150 + long), (10, None), (11, ""), (12, long[:100]), (13, long[:99] + "?")]
    rows += [(20 + k, "same line " * 11 + str(k) * 30) for k in range(40)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


def test_shares_of_an_anchor_meet_again(spark, monkeypatch):
    """One passage in many documents, each with text of its own around it: its anchors have many different stretches."""
    monkeypatch.setattr(suffixdedup, "GROUP", 8)
    rng = random.Random(4)
    own = lambda: "".join(rng.choice("abcdefgh ") for _ in range(60))
    passage = "".join(rng.choice("ijklmnop ") for _ in range(140))
    rows = [(i, own() + passage + own()) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs) == plain(rows)
    assert without_repeats(docs).filter(F.col("n_removed") >= 140).count() == 119


@pytest.mark.parametrize("bucket", [7, 1 << 16])
@pytest.mark.parametrize("alphabet", [b"ab", b"abcdefgh\0", b"abcdefghijklmnopq "])
def test_classes_of_suffixes(monkeypatch, bucket, alphabet):
    monkeypatch.setattr(suffixes, "BUCKET", bucket)
    rng = random.Random(bucket + len(alphabet))
    base = [bytes(rng.choice(alphabet) for _ in range(300)) for _ in range(3)]
    own = []
    for _ in range(60):
        a, n = rng.randrange(0, 200), rng.randrange(100, 185)
        t = bytearray(rng.choice(base)[a : a + n])
        t += b"z" * (100 - len(t))
        if rng.random() < 0.4:
            t[rng.randrange(len(t))] = 65
        own.append(bytes(t))
    own += [b"x" * 150] * 3 + [b"xy" * 80]
    begin = np.cumsum([0, *[len(t) + suffixes.PAD for t in own]])[:-1]
    length = np.array([len(t) for t in own])
    data = np.frombuffer(b"".join(t + bytes(suffixes.PAD) for t in own), np.uint8)
    block = suffixes.Block(data, begin, length)
    # the sample's ranks are the order of its suffixes
    place = {int(b) + k: t[k:] for b, t in zip(begin, own, strict=True) for k in range(len(t)) if (b + k) % suffixes.PERIOD in suffixes.COVER}
    ranks = [int(block.rank[p]) for p in sorted(place, key=place.get)]
    assert ranks == sorted(ranks) and len(set(ranks)) == len(set(place.values()))
    at = suffixes.ragged(begin, length - 99)
    ours, theirs = set(), {}
    for members, number in block.equal_classes(at):
        ours |= {frozenset(at[members[number == k]].tolist()) for k in set(number.tolist())}
    for p in at.tolist():
        theirs.setdefault(data[p : p + 100].tobytes(), set()).add(p)
    assert ours == {frozenset(x) for x in theirs.values() if len(x) > 1}
