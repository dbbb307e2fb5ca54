"""Places of whole rankings at a size where range partitions are drawn from a sample."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import model, search

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("parts", [8, 32, 200])
def test_places_are_one_to_n(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        orders = spark.read.parquet(f"{SF}/orders.parquet")  # with all their columns
        n = orders.count()
        placed = search.ranked(orders, [F.desc("o_totalprice"), F.asc("o_orderkey")])
        assert placed.columns == [*orders.columns, "pos"]
        row = placed.agg(F.count_distinct("pos").alias("n"), F.min("pos").alias("least"), F.max("pos").alias("most")).first()
        assert (row.n, row.least, row.most) == (n, 1, n)
        by_place = [r.o_totalprice for r in placed.orderBy("pos").select("o_totalprice").limit(500).collect()]
        assert by_place == sorted(by_place, reverse=True)
        ids = model.number_new(orders, "o_orderkey", ["o_orderdate", "o_orderkey"], 1000)
        row = ids.agg(F.count_distinct("id").alias("n"), F.min("id").alias("least"), F.max("id").alias("most")).first()
        assert (row.n, row.least, row.most) == (n, 1001, 1000 + n)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_far_pages_equal_near_ones(spark, monkeypatch):
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").select("o_orderkey", "o_totalprice")
    order = [F.asc("o_totalprice"), F.asc("o_orderkey")]
    near = [tuple(r) for r in search.page(orders, order, 700, 50).orderBy("pos").collect()]
    monkeypatch.setattr(search, "NEAR_PAGES", 100)
    assert [tuple(r) for r in search.page(orders, order, 700, 50).orderBy("pos").collect()] == near and len(near) == 50
