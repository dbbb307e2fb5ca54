"""An order's keys are columns: a sort of rows works no text out."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from lectern.operators import search


@pytest.mark.parametrize("sort", ["title", "author", "added"])
def test_pages_sort_by_columns(spark, sort):
    rows = [(k, title, None if k % 3 else "x", k % 2) for k, title in enumerate(["b", "  B", "A\ta", None, "a  A", "ß", "SS", "", "b"])]
    books = search.with_title_key(spark.createDataFrame(rows, "book_id long, title string, author_sort string, added_at long"))
    order = search.order_of(sort)
    page = search.page(books, order, 2, 5)
    assert page.columns == ["book_id", "title", "author_sort", "added_at", "pos"]
    whole = {r.book_id: r.pos for r in search.ranked(books, order, keep=["book_id"]).collect()}
    assert sorted(whole.values()) == list(range(1, 10))
    assert {r.book_id: r.pos for r in page.collect()} == {k: v for k, v in whole.items() if 2 < v <= 7}
    if sort == "title":  # nulls first, then by the normalised title, the title and the id
        assert sorted(whole, key=whole.get) == [3, 7, 2, 4, 1, 0, 8, 6, 5]
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        books.orderBy(*order).limit(7).explain()
    assert all("translate" not in line for line in out.getvalue().splitlines() if "TakeOrderedAndProject" in line)
    assert search.TITLE_KEY not in search.ranked(books, [F.col("book_id")], keep=["book_id"]).columns
