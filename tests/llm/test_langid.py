"""The language models against Kneser-Ney smoothing put together from the definition."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import langid

TEXTS = {"x": ["abra cadabra, abba", "Aba caba! abra", "cab"], "y": ["xyz zyx abz", "zz-top Xyz", "yyx"]}


def ngrams(text):
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        padded = "   " + word + "$"
        for i in range(3, len(padded)):
            yield padded[i - 3 : i + 1]


class Brute:
    def __init__(self, texts, letters):
        counts = {4: Counter(g for t in texts for g in ngrams(t))}
        for order in (3, 2, 1):
            counts[order] = Counter(g[1:] for g in counts[order + 1])
        self.counts, self.letters, self.off, self.total, self.kinds = counts, letters, {}, defaultdict(int), defaultdict(int)
        for order, own in counts.items():
            ones, twos = (sum(n == k for n in own.values()) for k in (1, 2))
            self.off[order] = ones / (ones + 2 * twos) if ones and twos else 0.5
            for g, n in own.items():
                self.total[order, g[:-1]] += n
                self.kinds[order, g[:-1]] += 1

    def p(self, g):
        if not g:
            return 1 / (1 + self.letters)
        order, total = len(g), self.total[len(g), g[:-1]]
        if not total:
            return self.p(g[1:])
        off = self.off[order]
        return max(self.counts[order][g] - off, 0) / total + off * self.kinds[order, g[:-1]] / total * self.p(g[1:])

    def entropy(self, text):
        found = list(ngrams(text))
        return -sum(math.log(self.p(g)) for g in found) / len(found)


def test_entropies_equal_the_definition(spark, monkeypatch):
    rows = [(t, lang) for lang, texts in TEXTS.items() for t in texts]
    monkeypatch.setattr(langid, "FILE_ROWS", 20)  # several files
    models = langid.model_of(spark.createDataFrame(rows, "text string, lang string"))
    assert len(models.files) > 1 and models.languages == ["x", "y"]
    letters = len({g[-1] for t, _ in rows for g in ngrams(t)})
    brute = [Brute(TEXTS[lang], letters) for lang in models.languages]
    probes = ["abra", "Xyz caba", "qqq", "zebra, abc yyx!", *(t for t, _ in rows)]
    for size in (1 << 20, 7):  # whole, and in passes
        monkeypatch.setattr(langid, "PASS", size)
        got, n = langid.Models.entropies(models, probes)
        assert n.tolist() == [len(list(ngrams(t))) for t in probes]
        assert np.allclose(got, [[b.entropy(t) for b in brute] for t in probes], atol=1e-9)
    monkeypatch.setattr(langid, "CELLS", 5)  # few n-grams at a time, as with many languages
    assert np.allclose(models.entropies(probes)[0], got, atol=1e-9)


def test_probabilities_sum_to_one(spark):
    models = langid.model_of(spark.createDataFrame([(t, "x") for t in TEXTS["x"]], "text string, lang string"))
    letters = [0, *(ord(c) for c in "abcdr")]
    for head in ("abr", "cab", "ddd"):
        context = sum(ord(c) << s for c, s in zip(head, (48, 32, 16), strict=True))
        total = np.exp(models.log_probabilities(np.unique(np.array([context | x for x in letters], np.uint64))))[:, 0].sum()
        assert 0.75 < total <= 1 + 1e-9  # the rest is left to characters never seen


def test_letters_of_all_planes_and_many_languages(spark):
    wide = "".join(chr(0x20000 + k % 500) for k in range(90))
    rows = [(i, wide if i % 2 else "plain words here", "zz" if i % 2 else "en") for i in range(60)] + [(100 + i, f"{chr(97 + i % 26) * 3}{chr(97 + i // 26) * 4} words", f"l{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify_languages(docs).collect()}
    assert all(got[i].lang_pred == ("zz" if i % 2 else "en") for i in range(60))
    learned = {r.lang for r in docs.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).select("lang").distinct().collect()}
    assert len(learned) > 200 and {r.lang_pred for r in got.values()} <= learned
    assert np.mean([got[100 + i].lang_pred == f"l{i}" for i in range(300) if f"l{i}" in learned]) > 0.9


def test_all_counts_are_kept(spark):
    """As many n-grams as brute force finds, however rare they are."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tables = langid.count(docs.filter("lang is not null"))
    texts = defaultdict(list)
    for r in docs.collect():
        if r.lang is not None:
            texts[r.lang].append(r.text or "")
    want = {lang: len({g for t in own for g in ngrams(t)}) for lang, own in texts.items()}
    assert {r.lang: r["count"] for r in tables[-1].groupBy("lang").count().collect()} == want
