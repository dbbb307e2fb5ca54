"""Catalogue search: predicates, facets, orders and pages (F, P, J2-J5, A1-A5, O1-O7)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.fields import LOWER, UPPER
from lectern.functions.text import arrow_tokens, normalize, token_pairs, tokens
from lectern.storage import cut

#: Rows that one task may rank for a page.
NEAR_PAGES = 10_000
FIELDS = ("title", "authors", "description")


@dataclass(frozen=True)
class CatalogQuery:
    """What a user may ask. Empty lists and an empty text don't filter; no fields means all."""

    text: str = ""
    fields: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    genres: tuple[str, ...] = ()
    sort: str = "title"
    ascending: bool = True
    offset: int = 0
    limit: int = 50

    def __post_init__(self):
        if unknown := set(self.fields) - set(FIELDS):
            raise ValueError(f"unknown fields {sorted(unknown)}")
        if self.sort not in ("title", "author", "added"):
            raise ValueError(f"unknown sort {self.sort}")
        if self.offset < 0 or not 0 < self.limit <= 200:
            raise ValueError("offset must be 0 or more, limit 1 to 200")

    def fingerprint(self) -> str:
        """Hash of what decides the ranking, whatever the order in which values were given; not of the page."""
        own = {k: sorted(set(v)) if isinstance(v, tuple) else v for k, v in asdict(self).items() if k not in ("offset", "limit")}
        return hashlib.sha256(json.dumps(own, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


@dataclass(frozen=True)
class Cursor:
    """A place in a published ranking."""

    snapshot: str
    query: str
    position: int = field(default=0)


class StaleCursor(ValueError):
    """The cursor belongs to another snapshot or query, or lies outside the ranking."""


def nocase(c: Column) -> Column:
    """The key of an order that takes A-Z and a-z as equal and nothing else."""
    return F.translate(c, UPPER, LOWER)


def canonical_values(c: Column) -> Column:
    """A list of values normalised, each once, ascending."""
    return F.array_sort(F.array_distinct(F.transform(c, normalize)))


def match_tokens(books: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Books where every token of text starts some token of some of the columns. '' matches all; a text without tokens none."""
    if text == "":
        return books
    wanted = tokens(F.lit(text))
    have = F.flatten(F.array(*[F.coalesce(tokens(F.col(c)), F.array().cast("array<string>")) for c in columns]))
    # the tokens of a row are made once; the check on its size keeps an empty query from matching all
    return books.withColumn("_have", have).filter((F.size(wanted) > 0) & F.forall(wanted, lambda t: F.exists("_have", lambda h: h.startswith(t)))).drop("_have")


def postings(books: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(token, field, key): the inverted index, one row for each distinct token of a field."""
    parts = [books.select(F.explode(F.array_distinct(tokens(F.col(c)))).alias("token"), F.lit(c).alias("field"), key) for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


#: Ids of a block of postings: those with one number of id >> SPAN_BITS.
SPAN_BITS = 12


def block_of(key: Column) -> Column:
    return F.shiftright(key.cast("long"), SPAN_BITS)


def posting_blocks(index: DataFrame, key: str) -> DataFrame:
    """(token, field, block, ids): the postings of a token and field, a row for each block of ids, ascending in it.

    A block's number bounds its ids and is the same for all tokens. So no row has over 4,096 ids, and a token that every
    book has is as many rows as there are blocks.
    """
    grouped = index.filter(F.col(key).isNotNull()).groupBy("token", "field", block_of(F.col(key)).alias("block"))
    return grouped.agg(F.array_sort(F.collect_set(F.col(key).cast("long"))).alias("ids"))


#: Columns of an index in blocks.
BLOCKS = "token string, field string, block long, ids array<long>"


#: Bytes of an Arrow batch, about, whose words are told apart at once. They bound a task's memory, not the input.
BATCH_BYTES = 4 << 20
#: Lists of a block and field from some of the books: tokens in a string, the length of each one's list, the lists' places in the block.
RUNS = "block long, field int, words string, sizes binary, places binary"
LOW = (1 << SPAN_BITS) - 1


def text_blocks(books: DataFrame, key: str, columns: list[str], parts: int | None = None) -> DataFrame:
    """posting_blocks() of the postings of books, without a row for each posting: tasks turn the texts that they read into lists, and the lists of a block are put together. parts: how many tasks the blocks are dealt to."""
    books.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    pairs, fields = token_pairs(), len(columns)
    texts = books.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_id"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(columns)])
    runs = texts.mapInArrow(lambda batches: block_runs(batches, fields, pairs), RUNS)
    return (runs.repartition(parts, "block") if parts else runs).groupBy("block").applyInArrow(lambda own: joined_runs(own, columns), BLOCKS)


def _cut_lists(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys ascending, what they have above the place in a block, where that changes, with the end)."""
    keys = np.sort(keys)
    keys = keys[_starts(keys)]
    above = keys >> SPAN_BITS
    starts = np.flatnonzero(_starts(above))
    return keys, above[starts], np.append(starts, len(keys))


def _starts(values: np.ndarray) -> np.ndarray:
    """Whether a value differs from the one before it."""
    out = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=out[1:])
    return out


def _shorts(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary value of 16-bit numbers for each of the ranges."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * 2).astype(np.int32)), pa.py_buffer(values.astype("<u2"))])


def block_runs(batches: Iterable[pa.RecordBatch], fields: int, pairs: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    """RUNS of books: _id and a text for each field."""
    for own in batches:
        ids = own["_id"].to_numpy()
        blocks, block = np.unique(ids >> SPAN_BITS, return_inverse=True)
        for i in range(fields):
            known, row, token = arrow_tokens(own[f"_{i}"], pairs)
            if not len(row):
                continue
            keys, lists, bounds = _cut_lists((block * len(known) << SPAN_BITS | ids & LOW)[row] + (token.astype(np.int64) << SPAN_BITS))
            of, token = np.divmod(lists, len(known))
            first = np.flatnonzero(_starts(of))
            ends = np.append(first, len(of))
            words = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), known.take(pa.array(token))), " ")
            n = len(first)
            yield pa.RecordBatch.from_pydict({
                "block": pa.array(blocks[of[first]], pa.int64()), "field": pa.array(np.full(n, i, np.int32)), "words": words,
                "sizes": _shorts(np.diff(bounds), ends), "places": _shorts(keys & LOW, bounds[ends]),
            })


def joined_runs(own: pa.Table, columns: list[str]) -> pa.Table:
    """The rows of an index of one block, which has at most 4,096 ids, by field and token. own: RUNS."""
    block, out = own["block"][0].as_py(), []
    for i, name in enumerate(columns):
        runs = own.filter(pc.equal(own["field"], i))
        shorts = lambda column: np.frombuffer(b"".join(runs[column].to_pylist()), "<u2")  # noqa: B023, E731
        coded = pc.split_pattern(runs["words"].cast(pa.large_string()), " ").combine_chunks().flatten().dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        keys, _, bounds = _cut_lists(np.repeat(rank[coded.indices.to_numpy()], shorts("sizes")) << SPAN_BITS | shorts("places"))
        n, ids = len(order), pa.array(keys & LOW | block << SPAN_BITS, pa.int64())
        out.append(pa.table({"token": coded.dictionary.take(order).cast(pa.string()), "field": pa.repeat(name, n), "block": pa.repeat(pa.scalar(block, pa.int64()), n), "ids": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), ids)}))
    return pa.concat_tables(out)


def ids_by_block(keys: DataFrame, key: str) -> DataFrame:
    """(block, ids) of the distinct keys."""
    return keys.groupBy(block_of(F.col(key)).alias("block")).agg(F.collect_set(F.col(key).cast("long")).alias("ids"))


def live_blocks(blocks: DataFrame, gone: DataFrame | None) -> DataFrame:
    """Blocks (with _seq) without the ids that a later part says are gone. gone: (block, ids, _at)."""
    if gone is None:
        return blocks.drop("_seq")
    dead = gone.groupBy("block").agg(F.collect_list(F.struct("_at", F.col("ids").alias("out"))).alias("_gone"))
    later = F.flatten(F.transform(F.filter("_gone", lambda g: g["_at"] > F.col("_seq")), lambda g: g["out"]))
    own = blocks.join(dead, "block", "left").withColumn("ids", F.when(F.col("_gone").isNull(), F.col("ids")).otherwise(F.array_except("ids", later)))
    return own.filter(F.size("ids") > 0).select("token", "field", "block", "ids")


def in_token_order(blocks: DataFrame) -> DataFrame:
    """Blocks sorted in their tasks, so that a search reads the pages of its prefixes alone. A token's blocks are in many tasks, so a common one is spread over files without being dealt anew."""
    return blocks.sortWithinPartitions("token", "block")


def write_postings(index: DataFrame, key: str, path: str) -> None:
    """Stores an index of postings in blocks."""
    in_token_order(posting_blocks(index, key)).write.mode("overwrite").parquet(path)


def write_index(books: DataFrame, key: str, columns: list[str], path: str) -> None:
    """Stores the index of books in blocks. Books are counted, so that a task and a file have those of about one block, whatever the input."""
    parts = (books.count() >> SPAN_BITS) + 1
    in_token_order(text_blocks(books, key, columns, parts)).write.mode("overwrite").parquet(path)


def search_postings(index: DataFrame, key: str, wanted: list[str], fields: list[str]) -> DataFrame:
    """Distinct keys that have, for every wanted token, a token that starts with it in some of the fields. index: blocks.

    The prefixes are a filter of the scan. With several tokens, blocks that some token isn't in are skipped by their
    numbers, before their ids are looked at; the ids of the others meet in a count, so any number of tokens takes one
    shuffle of ids.
    """
    if not wanted:
        return index.select(F.lit(None).cast("long").alias(key)).limit(0)
    asked = sorted(set(wanted))
    any_of = reduce(lambda a, b: a | b, [F.col("token").startswith(t) for t in asked])
    hits = F.array_compact(F.array(*[F.when(F.col("token").startswith(t), F.lit(i)) for i, t in enumerate(asked)]))
    own = index.filter(F.col("field").isin(fields) & any_of)
    if len(asked) > 1:
        whole = own.select("block", F.explode(hits).alias("_t")).groupBy("block").agg(F.count_distinct("_t").alias("_n")).filter(F.col("_n") == len(asked))
        own = own.join(whole.select("block"), "block", "left_semi")
    found = own.select(F.explode("ids").alias(key), hits.alias("_h")).select(key, F.explode("_h").alias("_t"))
    return found.groupBy(key).agg(F.count_distinct("_t").alias("_n")).filter(F.col("_n") == len(asked)).select(key)


def filter_languages(books: DataFrame, languages: list[str], column: str = "language") -> DataFrame:
    return books.filter(F.col(column).isin(languages)) if languages else books


def filter_genres(books: DataFrame, book_genres: DataFrame, genres: list[str], key: str = "book_id") -> DataFrame:
    """Books of any of the genres, compared by normalised name. book_genres: (key, genre)."""
    if not genres:
        return books
    wanted = F.array(*[normalize(F.lit(g)) for g in genres])
    return books.join(book_genres.filter(F.array_contains(wanted, normalize(F.col("genre")))).select(key).distinct(), key, "left_semi")


def facet(rows: DataFrame, value: str, key: str) -> DataFrame:
    """(value, n, pos): distinct keys of each value but '', in nocase order."""
    counted = rows.filter((F.col(value) != "") & F.col(value).isNotNull()).groupBy(value).agg(F.count_distinct(key).alias("n"))
    return ranked(counted, [nocase(F.col(value)), F.col(value)])


def ranked(df: DataFrame, order: list[Column], name: str = "pos", keep: list[str] | None = None) -> DataFrame:
    """df, or the columns of it to keep, with its place in the order, from 1. Ranks are local to range partitions and shifted by the partitions before, so no task sees all rows.

    The dealt rows are written once, as another evaluation may draw other bounds between the partitions. Rows that are
    equal in all of the order get places in no order of their own.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()})
    dealt = cut(dealt.select("_p", "_m", *(keep or df.columns)), "ranked")
    counts = dealt.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = counts.select("_p", "_first", before.alias("_before"))  # a row for each partition
    return dealt.join(F.broadcast(shift), "_p").withColumn(name, (F.col("_m") - F.col("_first") + F.col("_before") + 1).cast("long")).drop("_p", "_m", "_first", "_before")


def author_keys(book_authors: DataFrame, key: str = "book_id", name: str = "author") -> DataFrame:
    """(key, author_sort): the least normalised author name of each book."""
    return book_authors.groupBy(key).agg(F.min(normalize(F.col(name))).alias("author_sort"))


#: The normalised title, by which orders go.
TITLE_KEY = "_title_key"


def with_title_key(books: DataFrame, title: str = "title") -> DataFrame:
    """books with the column that order_of() names. A sort works an expression out for each comparison; a column it only reads."""
    return books.withColumn(TITLE_KEY, normalize(F.col(title)))


def order_of(sort: str, ascending: bool = True, title: str = "title", key: str = "book_id") -> list[Column]:
    """Sort keys of rows that have their title key; ties go by it and by id, ascending. Nulls are first ascending and last descending."""
    lead = F.col({"title": TITLE_KEY, "author": "author_sort", "added": "added_at"}[sort])
    rest = [F.col(title).asc(), F.col(key).asc()] if sort == "title" else [F.col(TITLE_KEY).asc(), F.col(key).asc()]
    return [lead.asc() if ascending else lead.desc(), *rest]


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """The rows of a page with `pos` from 1. Up to NEAR_PAGES only offset + limit rows are ranked, in one task; pages further on are cut from the whole ranking."""
    if offset + limit > NEAR_PAGES:
        return ranked(df, order, keep=[c for c in df.columns if c != TITLE_KEY]).filter((F.col("pos") > offset) & (F.col("pos") <= offset + limit))
    top = df.orderBy(*order).limit(offset + limit)
    place = F.row_number().over(Window.orderBy(*order))
    return top.withColumn("pos", place).filter(F.col("pos") > offset).drop(TITLE_KEY)


def publish_ranking(df: DataFrame, order: list[Column], key: str, snapshot: str, query: CatalogQuery, path: str) -> int:
    """Ranks once and writes (pos, key) under the snapshot and the query's hash; returns the number of rows."""
    out = f"{path}/snapshot_id={snapshot}/query={query.fingerprint()}"
    ranked(df, order, keep=[key]).select("pos", key).write.mode("overwrite").parquet(out)
    return df.sparkSession.read.parquet(out).count()


def read_slice(spark, path: str, cursor: Cursor, snapshot: str, query: CatalogQuery, limit: int, total: int) -> DataFrame:
    """The next rows of a published ranking, in its order."""
    if cursor.snapshot != snapshot or cursor.query != query.fingerprint() or not 0 <= cursor.position <= total:
        raise StaleCursor("the cursor doesn't belong to this snapshot and query")
    rows = spark.read.parquet(f"{path}/snapshot_id={snapshot}/query={cursor.query}")
    return rows.filter((F.col("pos") > cursor.position) & (F.col("pos") <= cursor.position + limit)).orderBy("pos")


def ordered_names(rows: DataFrame, key: str, order: list[str], name: str, alias: str) -> DataFrame:
    """(key, names in order) of a relation."""
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, name))), lambda x: x[name]).alias(alias))


def fetch(ids: DataFrame, books: DataFrame, key: str = "book_id") -> DataFrame:
    """Books of a list of (pos, key), in its order, those that aren't there left out."""
    return ids.join(books, key)
