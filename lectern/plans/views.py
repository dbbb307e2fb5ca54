"""The catalogue's tables as views of the given TPC-H-like tables, in Spark and in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import search
from lectern.storage import exists, file_states, new_folder

#: Stored indexes by folder and state of its files, for the life of the driver.
_INDEXES: dict[tuple, str] = {}


class Tables:
    """Tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def books(self) -> DataFrame:
        """A document is a book: its first line is the title."""
        title = F.split_part("text", F.lit("\n"), F.lit(1))
        return self.documents.select(F.col("doc_id").alias("book_id"), title.alias("title"), F.col("lang").alias("language"), F.col("source").alias("publisher"), F.col("text").alias("description"), F.col("n_chars").alias("size_bytes"))

    def postings(self) -> DataFrame:
        """The stored search index of the books. It is written once for a state of the documents' files, as a snapshot's index is."""
        key = (self.spark.sparkContext.applicationId, *file_states(self.spark, f"{self.sf_dir}/documents.parquet"))
        if key not in _INDEXES or not exists(self.spark, f"{_INDEXES[key]}/_SUCCESS"):
            path = new_folder(self.spark, "index")
            search.write_index(self.books, "book_id", ["title", "description"], path)
            _INDEXES[key] = path
        return self.spark.read.parquet(_INDEXES[key])

    @cached_property
    def book_genres(self) -> DataFrame:
        return self.part.select(F.col("p_partkey").alias("book_id"), F.col("p_type").alias("genre"))

    @cached_property
    def parts(self) -> DataFrame:
        return self.part.select(F.col("p_partkey").alias("book_id"), F.col("p_name").alias("title"), F.col("p_type").alias("genre"), F.col("p_brand").alias("author"), F.col("p_size").alias("series_index"))

    @cached_property
    def book_authors(self) -> DataFrame:
        rows = self.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.min("l_linenumber").alias("author_order"))
        return rows.select(F.col("l_partkey").alias("book_id"), F.col("l_suppkey").alias("author_id"), "author_order")

    @cached_property
    def authors(self) -> DataFrame:
        return self.supplier.select(F.col("s_suppkey").alias("author_id"), F.col("s_name").alias("author"), F.col("s_nationkey").alias("nation"))

    @cached_property
    def segments(self) -> DataFrame:
        on = F.when(F.col("o_orderstatus").isin("F", "O"), "available").otherwise("missing_from_index")
        return self.orders.select(F.col("o_orderkey").alias("segment_id"), F.col("o_orderkey").alias("segment_order"), on.alias("availability"), F.col("o_orderpriority").alias("name"))

    @cached_property
    def locations(self) -> DataFrame:
        """The latest line of each part that isn't a tombstone."""
        order = F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
        last = self.lineitem.filter("l_returnflag <> 'R'").groupBy("l_partkey").agg(F.max(order).alias("r"))
        return last.select(F.col("l_partkey").alias("lib_id"), F.col("r.l_orderkey").alias("segment_id"), F.col("r.l_extendedprice").alias("size"), (F.col("r.l_quantity") > 5).alias("present_in_segment"))

    @cached_property
    def deletions(self) -> DataFrame:
        return self.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("segment_id"), F.col("l_partkey").alias("lib_id")).distinct()

    @cached_property
    def old_segments(self) -> DataFrame:
        return self.orders.filter("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("segment_id"), F.sha2(F.col("o_orderstatus").cast("binary"), 256).alias("fingerprint"))

    @cached_property
    def new_segments(self) -> DataFrame:
        salted = F.when(F.col("o_orderkey") % 7 == 0, F.concat("o_orderstatus", F.lit("x"))).otherwise(F.col("o_orderstatus"))
        return self.orders.filter("o_orderkey % 10 <> 1").select(F.col("o_orderkey").alias("segment_id"), F.sha2(salted.cast("binary"), 256).alias("fingerprint"))

    @cached_property
    def warnings(self) -> DataFrame:
        return self.events.filter("event_type = 'error'").select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("scan_id"), F.col("user_id").alias("source"), F.col("props").alias("message"))

    @cached_property
    def stages(self) -> DataFrame:
        return self.events.select(F.col("event_type").alias("stage"), F.col("user_id").alias("archive"), F.col("value").alias("elapsed_ms"), "event_id", "ts")


SQL = {
    "books": "select doc_id as book_id, split_part(text, chr(10), 1) as title, lang as language, source as publisher, text as description, n_chars as size_bytes from documents",
    "parts": "select p_partkey as book_id, p_name as title, p_type as genre, p_brand as author, p_size as series_index from part",
    "book_authors": "select l_partkey as book_id, l_suppkey as author_id, min(l_linenumber) as author_order from lineitem group by 1, 2",
    "authors": "select s_suppkey as author_id, s_name as author, s_nationkey as nation from supplier",
    "segments": "select o_orderkey as segment_id, o_orderkey as segment_order, case when o_orderstatus in ('F', 'O') then 'available' else 'missing_from_index' end as availability, o_orderpriority as name from orders",
    "locations": "select l_partkey as lib_id, l_orderkey as segment_id, l_extendedprice as size, l_quantity > 5 as present_in_segment from lineitem where l_returnflag <> 'R' qualify row_number() over (partition by l_partkey order by l_orderkey desc, l_linenumber desc, l_extendedprice desc, l_quantity desc) = 1",
    "deletions": "select distinct l_orderkey as segment_id, l_partkey as lib_id from lineitem where l_returnflag = 'R'",
    "old_segments": "select o_orderkey as segment_id, sha256(o_orderstatus) as fingerprint from orders where o_orderkey % 10 <> 0",
    "new_segments": "select o_orderkey as segment_id, sha256(case when o_orderkey % 7 = 0 then o_orderstatus || 'x' else o_orderstatus end) as fingerprint from orders where o_orderkey % 10 <> 1",
    "warnings": "select event_id as id, strftime(ts, '%Y-%m-%d') as scan_id, user_id as source, props as message from events where event_type = 'error'",
    "stages": "select event_type as stage, user_id as archive, value as elapsed_ms, event_id, ts from events",
}


def with_views(sql: str, *names: str) -> str:
    """SQL with views of the catalogue as named subqueries before it."""
    return "with " + ", ".join(f"v_{n} as ({SQL[n]})" for n in names) + " " + sql
