"""Catalogue tables: merges, dimensions, bridges, covers and exports (K)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import normalize


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and those of old whose key isn't among them (K2, K3, K7)."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def replace_owned(old: DataFrame, new: DataFrame, owner: str, changed: DataFrame) -> DataFrame:
    """Rows of old whose owner didn't change, and all of new. changed: (owner)."""
    return new.unionByName(old.join(changed.select(owner).distinct(), owner, "left_anti"))


def merge_books(old: DataFrame, new: DataFrame, key: str, values: list[str], scan_time: Column) -> DataFrame:
    """New and kept books: an insert gets the scan's time, an update keeps `added_at` (K4). is_new tells them apart."""
    o = old.select(key, F.col("added_at"), F.lit(True).alias("_old"), *[F.col(v).alias(f"_old_{v}") for v in values])
    n = new.select(key, F.lit(True).alias("_new"), *values)
    both = o.join(n, key, "full_outer")
    chosen = [F.when(F.col("_new").isNotNull(), F.col(v)).otherwise(F.col(f"_old_{v}")).alias(v) for v in values]
    return both.select(key, F.coalesce("added_at", scan_time).alias("added_at"), F.col("_old").isNull().alias("is_new"), *chosen)


def number_new(rows: DataFrame, key: str, order: list[str], start: int) -> DataFrame:
    """rows with `id` from start + 1 in the given order; ranks come from range partitions."""
    from .search import ranked

    return ranked(rows, [F.col(c) for c in order], "_n").withColumn("id", F.col("_n") + start).drop("_n")


def new_names(old: DataFrame, names: DataFrame, order: str) -> DataFrame:
    """(normalized_name, display_name) of names that weren't known, as they were written first. names: (name, order)."""
    found = names.withColumn("normalized_name", normalize(F.col("name"))).filter("normalized_name <> ''")
    first = found.groupBy("normalized_name").agg(F.min_by("name", order).alias("display_name"))
    return first.join(old, "normalized_name", "left_anti")


def resolve_dimension(old: DataFrame, names: DataFrame, order: str) -> DataFrame:
    """(normalized_name, display_name): names known before, and new ones as they were written first (K5). names: (name, order)."""
    return old.select("normalized_name", "display_name").unionByName(new_names(old, names, order))


def bridge(lists: DataFrame, owner: str, names: str) -> DataFrame:
    """(owner, normalized_name, ord): each name of a list once, at its first place; blanks dropped, places not closed up (K6).

    A list is settled in its own row, as equal names are neighbours once it is sorted by name and place. Owners are
    counted first: only those of several lists have names that must meet in a shuffle.
    """
    named = F.transform(names, lambda x, i: F.struct(normalize(x).alias("normalized_name"), i.alias("ord")))
    placed = lists.select(owner, F.array_sort(F.filter(named, lambda x: x["normalized_name"] != "")).alias("_names"))
    first = F.filter("_names", lambda x, i: (i == 0) | (F.get("_names", i - 1)["normalized_name"] != x["normalized_name"]))
    rows = placed.select(owner, F.inline(first))
    if lists.groupBy(owner).count().filter("count > 1").isEmpty():
        return rows
    return rows.groupBy(owner, "normalized_name").agg(F.min("ord").alias("ord"))


def bridge_rows(each: DataFrame, owner: str) -> DataFrame:
    """bridge() of lists whose names are rows already: (owner, pos, name)."""
    rows = each.withColumn("normalized_name", normalize(F.col("name"))).filter("normalized_name <> ''")
    return rows.groupBy(owner, "normalized_name").agg(F.min("pos").alias("ord"))


def cap_log(log: DataFrame, group: str, order: str, most: int = 1000, place: str | None = None) -> DataFrame:
    """The first rows of each group (K8), with their place if it is named."""
    ranked = log.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(order))).filter(F.col("_r") <= most)
    return ranked.withColumnRenamed("_r", place) if place else ranked.drop("_r")


def content_store(blobs: DataFrame, content: str, extension: Column) -> DataFrame:
    """(path, sha, size_bytes): each distinct content once under `ab/<sha>.<ext>` (K9)."""
    sha = F.sha2(F.col(content).cast("binary"), 256)
    rows = blobs.select(sha.alias("sha"), F.octet_length(content).cast("long").alias("size_bytes"), extension.alias("ext"))
    rows = rows.groupBy("sha").agg(F.min("ext").alias("ext"), F.max("size_bytes").alias("size_bytes"))
    return rows.select(F.concat(F.substring("sha", 1, 2), F.lit("/"), "sha", F.lit("."), "ext").alias("path"), "sha", "size_bytes")


def referenced(store: DataFrame, books: DataFrame, path: str) -> DataFrame:
    """Stored contents that some book names."""
    return store.join(books.select(path).distinct(), path, "left_semi")


def to_document(fields: list[str | Column]) -> Column:
    """A JSON document with explicit nulls."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def inp_lines(records: DataFrame, order: list[str], fields: list[Column], per_archive: int) -> DataFrame:
    """(archive_no, content, n): records as lines of 0x04-joined fields, so many to an archive in the given order."""
    from .search import ranked

    placed = ranked(records, [F.col(c) for c in order], "_n")
    lined = placed.select("_n", F.ceil(F.col("_n") / per_archive).cast("long").alias("archive_no"), F.concat_ws("\u0004", *fields).alias("line"))
    rows = F.array_sort(F.collect_list(F.struct("_n", "line")))
    return lined.groupBy("archive_no").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("content"), F.count("*").alias("n"))


def export_status(books: DataFrame) -> Column:
    """Why a payload may not be exported, in the order of the checks; `ready` if it may.

    Columns: availability, source_ok, archive_ok, manifest_ok, size_ok.
    """
    return (
        F.when(F.coalesce(F.col("availability"), F.lit("")) != "available", "unavailable")
        .when(~F.coalesce("source_ok", F.lit(False)), "source-changed")
        .when(~F.coalesce("archive_ok", F.lit(False)), "archive-changed")
        .when(~F.coalesce("manifest_ok", F.lit(False)), "manifest-changed")
        .when(~F.coalesce("size_ok", F.lit(False)), "size-mismatch")
        .otherwise("ready")
    )
