"""Catalogue and scan statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import normalize


def catalogue_statistics(locations: DataFrame, covers: DataFrame, store_bytes: int = 0) -> DataFrame:
    """One row: books, unavailable books, bytes of source, covers and store, and their total."""
    books = locations.agg(F.count("*").alias("books"), F.count_if(F.col("availability") != "available").alias("unavailable"), F.coalesce(F.sum("file_size_bytes"), F.lit(0)).cast("long").alias("source_bytes"))
    art = covers.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("cover_bytes"))
    return books.crossJoin(art).withColumns({"store_bytes": F.lit(store_bytes).cast("long"), "total_bytes": F.col("source_bytes") + F.col("cover_bytes") + store_bytes})  # one row each


def source_overview(locations: DataFrame, source: str) -> DataFrame:
    """(source, total, available, unavailable)."""
    on = F.col("availability") == "available"
    return locations.groupBy(source).agg(F.count("*").alias("total"), F.count_if(on).alias("available"), F.count_if(~on).alias("unavailable"))


def distinct_files(segments: DataFrame, path: str, size: str) -> DataFrame:
    """One row: number and bytes of the files that segments name, each once."""
    return segments.filter(F.col(path).isNotNull()).groupBy(path).agg(F.max(size).alias("_s")).agg(F.count("*").alias("files"), F.coalesce(F.sum("_s"), F.lit(0)).alias("bytes"))


def cover_references(books: DataFrame, path: str, size: str) -> DataFrame:
    """(path, reference_count, size_bytes): the size counts once."""
    return books.filter(F.col(path).isNotNull()).groupBy(path).agg(F.count("*").alias("reference_count"), F.max(size).alias("size_bytes"))


def budget(covers: DataFrame, limit: int) -> DataFrame:
    """One row: bytes of covers, and whether they fit (A10)."""
    return covers.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("used")).withColumn("within", F.col("used") <= limit)


def segment_counts(records: DataFrame, segment: str, deleted: Column, skipped: Column) -> DataFrame:
    """Records, parsed, deleted and skipped of each segment."""
    return records.groupBy(segment).agg(F.count("*").alias("records"), F.count_if(~skipped).alias("parsed"), F.count_if(~skipped & deleted).alias("deleted"), F.count_if(skipped).alias("skipped"))


def manifest_fingerprint(entries: DataFrame, archive: str, name: str, size: str, crc: str) -> DataFrame:
    """(archive, fingerprint): sha256 over `length:name:size:crc` lines in byte order of the names."""
    line = lambda e: F.concat(F.octet_length(e["name"]).cast("string"), F.lit(":"), e["name"], F.lit(":"), e["size"].cast("string"), F.lit(":"), e["crc"].cast("string"), F.lit("\n"))
    rows = F.array_sort(F.collect_list(F.struct(F.col(name).alias("name"), F.col(size).alias("size"), F.col(crc).alias("crc"))))
    return entries.groupBy(archive).agg(F.sha2(F.array_join(F.transform(rows, line), ""), 256).alias("fingerprint"))


def search_document(names: DataFrame, key: str, name: str, order: Column) -> DataFrame:
    """(key, document): normalised names in order, blanks left out, joined by blanks."""
    rows = names.withColumn("_n", normalize(F.col(name))).filter("_n <> ''")
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("_n").alias("n")))), lambda x: x["n"]), " ").alias("document"))


def stage_timing(events: DataFrame, groups: list[str], stage: str, elapsed: str) -> DataFrame:
    """Calls, total and mean time of each stage, its whole percent of its group's time, and its rank."""
    each = events.groupBy(*groups, stage).agg(F.count("*").alias("calls"), F.sum(elapsed).alias("total_ms"))
    whole, order = Window.partitionBy(*groups), Window.partitionBy(*groups).orderBy(F.desc("total_ms"), stage)
    return each.withColumns({"mean_ms": F.col("total_ms") / F.col("calls"), "percent": F.floor(F.col("total_ms") * 100 / F.sum("total_ms").over(whole)).cast("int"), "rank": F.rank().over(order)})


def throughput(events: DataFrame, groups: list[str], time: str) -> DataFrame:
    """Items of each group, and items a second between its first and last time; 0 where no time passed."""
    at = F.col(time).cast("timestamp")
    each = events.groupBy(*groups).agg(F.count("*").alias("items"), (F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))).alias("_us"))
    return each.withColumn("per_second", F.when(F.col("_us") > 0, F.col("items") * 1_000_000 / F.col("_us")).otherwise(F.lit(0.0))).drop("_us")


def outliers(events: DataFrame, elapsed: str, threshold: float = 5000) -> DataFrame:
    """Items that took the threshold or longer."""
    return events.filter(F.col(elapsed) >= threshold)


def fallback_counters(books: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """One row: books for which each field was taken from the record, and books with any such field."""
    any_of = reduce(lambda a, b: a | b, flags.values())
    return books.agg(*[F.count_if(c).alias(f"{name}_fallbacks") for name, c in flags.items()], F.count_if(any_of).alias("books_with_fallback"))


def latest(log: DataFrame, order: str, most: int) -> DataFrame:
    """The last rows with their place, newest first."""
    top = log.orderBy(F.desc(order)).limit(most)
    return top.withColumn("pos", F.row_number().over(Window.orderBy(F.desc(order))))


def retain_latest(log: DataFrame, group: str, order: str, most: int = 10) -> DataFrame:
    """Rows of the groups with the greatest last order."""
    keep = log.groupBy(group).agg(F.max(order).alias("_last")).orderBy(F.desc("_last")).limit(most)
    return log.join(keep.select(group), group, "left_semi")
