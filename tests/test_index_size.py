"""The stored index is made of books, not of single postings."""

import contextlib
import io

from pyspark.sql import functions as F

from lectern.operators import search


def _plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_books_become_blocks_without_a_row_for_each_posting(spark):
    rows = [(k, title, text) for k in (-5000, -1, 0, 1, 4095, 4096, 9000) for title, text in [("Der  Weg Straße", f"a b a {k} Über über"), (None, ""), ("— ;", None)]]
    books = spark.createDataFrame([*rows, (None, "no id", "no id"), (1, "again", "a z")], "book_id long, title string, description string")
    fields = ["title", "description"]
    ours = search.text_blocks(books, "book_id", fields)
    theirs = search.posting_blocks(search.postings(books, "book_id", fields), "book_id")
    key = lambda df: sorted(map(str, df.select("token", "field", "block", "ids").collect()))
    assert ours.columns == ["token", "field", "block", "ids"]
    assert key(ours) == key(theirs) and ours.count() > 20
    assert search.text_blocks(books.filter(F.lit(False)), "book_id", fields).isEmpty()


def test_the_index_of_the_tables_shuffles_books(spark, monkeypatch):
    from lectern.plans import views

    plans = []
    monkeypatch.setattr(views, "_INDEXES", {})
    inner = search.in_token_order
    monkeypatch.setattr(search, "in_token_order", lambda blocks: plans.append(_plan(blocks)) or inner(blocks))
    index = views.Tables(spark, "/root/testdata/sf0.001").postings()
    assert index.columns == ["token", "field", "block", "ids"] and not index.isEmpty()
    assert "Exchange" in plans[0] and "Generate" not in plans[0]  # no posting is a row before the exchange


def test_an_index_has_tasks_by_its_books(spark, folder):
    rows = spark.range(20_000).select(F.col("id").alias("book_id"), F.concat(F.lit("the x"), F.col("id") % 7).alias("description"))
    search.write_index(rows, "book_id", ["description"], folder + "/index")
    index = spark.read.parquet(folder + "/index")
    assert len(index.inputFiles()) > 1  # of small blocks Spark alone would make one task
    assert index.filter("token = 'the'").count() == 5
    assert search.search_postings(index, "book_id", ["th"], ["description"]).count() == 20_000
    assert search.search_postings(index, "book_id", ["th", "x3"], ["description"]).count() == len(range(3, 20_000, 7))


def test_tasks_send_lists_and_not_the_words_of_each_book(spark, monkeypatch, folder):
    """texts become lists before the exchange."""
    from lectern.plans import views

    n = 30_000
    text = " ".join(f"Wörd{k}, ünd" for k in range(60))
    books = spark.range(n, numPartitions=4).select(F.col("id").alias("doc_id"), F.concat(F.lit(f"{text}\n"), F.col("id") % 2).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars"))
    books.write.parquet(folder + "/documents.parquet")
    plans, inner = [], search.in_token_order
    monkeypatch.setattr(search, "in_token_order", lambda blocks: plans.append(_plan(blocks)) or inner(blocks))
    index = views.Tables(spark, folder).postings()
    below = plans[0].split("Exchange")[-1]
    assert "MapInArrow" in below and "translate(" not in below  # texts are cut into words in Arrow, once for a batch
    assert index.filter("token = 'und' and field = 'description'").agg(F.sum(F.size("ids"))).first()[0] == n
    assert search.search_postings(index, "book_id", ["word5", "1"], ["description"]).count() == n // 2


def test_runs_of_a_block_hold_each_word_once():
    import pyarrow as pa

    from lectern.functions.text import token_pairs

    ids = pa.array([5, 4096, 6, -1, 7], pa.int64())
    texts = pa.array(["The  the\tEnd", "end x-Y", None, "ß. the", "the —"])
    runs = list(search.block_runs([pa.RecordBatch.from_arrays([ids, texts], ["_id", "_0"])], 1, token_pairs()))
    assert len(runs) == 1 and sorted(runs[0]["block"].to_pylist()) == [-1, 0, 1]
    words = dict(zip(runs[0]["block"].to_pylist(), map(str.split, runs[0]["words"].to_pylist()), strict=True))
    assert {k: sorted(v) for k, v in words.items()} == {-1: ["ss", "the"], 0: ["end", "the"], 1: ["end", "x", "y"]}
    lists = search.joined_runs(pa.Table.from_batches(runs).filter(pa.compute.equal(pa.Table.from_batches(runs)["block"], 0)), ["a"]).to_pylist()
    assert [(r["token"], r["ids"]) for r in lists] == [("end", [5]), ("the", [5, 7])]


def test_arrow_tokens_are_those_of_a_column(spark):
    """All code points, pieces of several tokens, bytes that are no text."""
    import random

    from lectern.functions.text import token_pairs, tokens

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    random.Random(5).shuffle(points)
    rows = [(k, "".join(f"a{chr(c)}B{' ' if c % 5 == 0 else ''}" for c in points[i : i + 2000])) for k, i in enumerate(range(0, len(points), 2000))]
    rows += [(len(rows) + k, t) for k, t in enumerate(["", " ", None, "\n a\nb\n", "́", "x́y  ẞ ß  z", "a\x00b\x1cc\x85d"])]
    texts = spark.createDataFrame(rows, "book_id long, t string")
    texts = texts.unionAll(spark.sql("select 100000L, cast(unhex('61C3206220FF63E282') as string)"))
    one = texts.select("book_id", F.array_sort(F.array_distinct(tokens(F.col("t")))).alias("w")).filter(F.size("w") > 0)
    two = search.text_blocks(texts, "book_id", ["t"]).select(F.explode("ids").alias("book_id"), "token").groupBy("book_id").agg(F.array_sort(F.collect_list("token")).alias("w"))
    assert token_pairs() and {r.book_id: r.w for r in one.collect()} == {r.book_id: r.w for r in two.collect()}
