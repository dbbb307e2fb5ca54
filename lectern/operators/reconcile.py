"""Incremental rescans: segment differences, reuse, tombstones and availability (J7, J8, ST)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows that a task of a join by segments gets of each side, about.
TASK_ROWS = 1 << 18


def tasks_of(*sides: DataFrame) -> int:
    """To how many tasks the sides of a join are dealt."""
    return max(side.count() for side in sides) // TASK_ROWS + 1


def dealt(side: DataFrame, key: str, tasks: int) -> DataFrame:
    """A side of a join, dealt by key. Spark alone cuts tasks by compressed bytes, of which short rows have next to none, so that a task would get millions to sort."""
    return side.repartition(tasks, key) if tasks > 1 else side


def segment_changes(old: DataFrame, new: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """(key, change): added, changed, unchanged or removed."""
    tasks = tasks_of(old, new)
    before, after = (dealt(side.select(key, F.col(fingerprint).alias(name)), key, tasks) for side, name in ((old, "_old"), (new, "_new")))
    both = before.join(after, key, "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("changed")
    return both.select(key, change.alias("change"))


def reuse_plan(old: DataFrame, new: DataFrame, key: str, initial: bool = False) -> DataFrame:
    """(key, change, step): what each segment of the new source needs, by the first rule that holds (ST2).

    old: key, inp, availability, requires_archive, archive_stat, manifest; new: key, inp, archive_stat, manifest.
    step: same-text (no archive is needed), same-stat, same-manifest (payloads are checked again), or parse.
    """
    o = old.select(key, *[F.col(c).alias(f"_{c}") for c in ("inp", "availability", "requires_archive", "archive_stat", "manifest")])
    both = new.join(o, key, "left")
    same = F.lit(not initial) & (F.col("_inp") == F.col("inp")) & (F.col("_availability") == "available")
    step = (
        F.when(~F.coalesce(same, F.lit(False)), "parse")
        .when(~F.col("_requires_archive"), "same-text")
        .when(F.col("_archive_stat") == F.col("archive_stat"), "same-stat")
        .when(F.col("_manifest") == F.col("manifest"), "same-manifest")
        .otherwise("parse")
    )
    change = F.when(F.col("_inp").isNull(), "added").when(step == "parse", "changed").otherwise("unchanged")
    return both.select(key, change.alias("change"), step.alias("step"))


def suppressed(locations: DataFrame, deletions: DataFrame, segments: DataFrame) -> DataFrame:
    """(lib_id): books with a tombstone in an available segment of strictly later order.

    The latest tombstone of each id is all that matters, so the range condition becomes a grouped maximum and an equi-join.
    """
    latest = deletions.join(segments.filter("availability = 'available'"), "segment_id").groupBy("lib_id").agg(F.max("segment_order").alias("_last"))
    placed = locations.join(segments.select("segment_id", "segment_order"), "segment_id")
    return placed.join(latest, "lib_id").filter("_last > segment_order").select("lib_id")


def availability(locations: DataFrame, deletions: DataFrame, segments: DataFrame) -> DataFrame:
    """(lib_id, availability) from scratch: present, in an available segment and without a later tombstone (ST3)."""
    latest = deletions.join(segments.filter("availability = 'available'"), "segment_id").groupBy("lib_id").agg(F.max("segment_order").alias("_last"))
    placed = locations.join(segments.select("segment_id", "segment_order", F.col("availability").alias("_segment")), "segment_id", "left").join(latest, "lib_id", "left")
    held = F.col("present_in_segment") & (F.coalesce("_segment", F.lit("")) == "available") & (F.coalesce("_last", F.lit(-1)) <= F.col("segment_order"))
    return placed.select("lib_id", F.when(held, "available").otherwise("missing_from_index").alias("availability"))


def flips(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: how many books became unavailable and how many came back."""
    both = old.select("lib_id", F.col("availability").alias("_old")).join(new, "lib_id")
    gone = (F.col("_old") == "available") & (F.col("availability") != "available")
    back = (F.col("_old") != "available") & (F.col("availability") == "available")
    return both.agg(F.count_if(gone).alias("retired"), F.count_if(back).alias("restored"), F.count_if(gone | back).alias("changed"))


def mark_absent(old: DataFrame, new: DataFrame, changes: DataFrame) -> DataFrame:
    """(segment_id, lib_id, present_in_segment) of old rows: false where a changed segment no longer has the record (ST5)."""
    touched = changes.filter("change = 'changed'").select("segment_id", F.lit(True).alias("_touched"))
    still = new.select("segment_id", "lib_id").distinct().withColumn("_still", F.lit(True))
    rows = old.join(touched, "segment_id", "left").join(still, ["segment_id", "lib_id"], "left")
    return rows.select("segment_id", "lib_id", (F.col("_touched").isNull() | F.col("_still").isNotNull()).alias("present_in_segment"))


def reconcile(old: DataFrame, new: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows of the next snapshot: unchanged segments keep theirs, added and changed ones have the new (ST1, U2). Removed ones go.

    A task holds the segments of its share and lets the rows, which are many more, pass by unsorted.
    """
    tasks = tasks_of(old, new)
    # not a semi-join: Spark moves that below the dealing
    segments = lambda which: dealt(changes.filter(which).select("segment_id"), "segment_id", tasks).distinct().hint("shuffle_hash")
    kept = dealt(old, "segment_id", tasks).join(segments("change = 'unchanged'"), "segment_id")
    read = dealt(new, "segment_id", tasks).join(segments("change in ('added', 'changed')"), "segment_id")
    return kept.withColumn("origin", F.lit("reused")).unionByName(read.withColumn("origin", F.lit("parsed")))


def scan_counters(changes: DataFrame, records: DataFrame) -> DataFrame:
    """One row of counts: segments by change, records reused and read (A12). records: (segment_id, origin)."""
    kinds = changes.agg(*[F.count_if(F.col("change") == k).alias(f"segments_{k}") for k in ("added", "changed", "unchanged", "removed")])
    read = records.agg(F.count_if(F.col("origin") == "reused").alias("records_reused"), F.count_if(F.col("origin") == "parsed").alias("records_parsed"))
    return kinds.crossJoin(read)  # one row each


def changed_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new that old doesn't have, or has with other values."""
    values = [c for c in new.columns if c != key]
    before = old.select(key, F.struct(*values).alias("_old"))
    return new.join(before, key, "left").filter(~F.struct(*values).eqNullSafe(F.col("_old"))).select(new.columns)


def update_index(index: DataFrame, changed: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Postings without those of changed books, and the fresh ones (ST6)."""
    return index.join(changed.select(key).distinct(), key, "left_anti").unionByName(fresh)


def latest_per_job(progress: DataFrame, job: str, order: list[str]) -> DataFrame:
    """The last row of each job (ST7)."""
    rest = [c for c in progress.columns if c != job]
    return progress.groupBy(job).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(job, "_r.*")
