"""Archives by their listing, large archives, inferred folders, cover budgets, and progress as a stream."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.operators.quality import Rejected
from lectern.operators.reconcile import latest_per_job
from lectern.plans import ingest
from lectern.sources import archives
from lectern.streaming import progress

from .test_catalog import archive, drop, line, payload, source  # noqa: F401


def test_a_path_with_a_comma(spark, folder):
    os.mkdir(f"{folder}/a, b")
    archive(f"{folder}/a, b", "x,y", {1: b"one"})
    path = f"{folder}/a, b/x,y.zip"
    assert [r.name for r in archives.manifests(spark, [path]).collect()] == ["b1.fb2"]
    assert [bytes(r.content) for r in archives.payloads(spark.createDataFrame([(path, "b1.fb2")], "archive string, entry string")).collect()] == [b"one"]
    assert archives.manifests(spark, []).count() == 0


def test_a_large_archive_takes_several_tasks(spark, folder):
    with zipfile.ZipFile(f"{folder}/big.zip", "w") as z:
        for k in range(10_000):
            z.writestr(f"{k:05d}.fb2", b"%d" % k)
    wanted = spark.range(10_000).select(F.lit(f"{folder}/big.zip").alias("archive"), F.format_string("%05d.fb2", "id").alias("entry"))
    read = archives.payloads(wanted).withColumn("task", F.spark_partition_id())
    rows = read.groupBy("task").agg(F.count("*").alias("n"), F.min("entry").alias("a"), F.max("entry").alias("b")).orderBy("a").collect()
    assert len(rows) > 1 and sum(r.n for r in rows) == 10_000 and max(r.n for r in rows) < 8_000
    assert all(x.b < y.a for x, y in zip(rows[:-1], rows[1:], strict=True))  # runs that follow each other
    assert read.filter(F.col("content").cast("string").cast("int") != F.substring("entry", 1, 5).cast("int")).isEmpty()


def test_the_folder_of_a_source_is_inferred(spark, drop):  # noqa: F811
    for name in ("x", "y", "z"):
        os.mkdir(f"{drop}/{name}")
    archive(f"{drop}/x", "a", {1: payload("One")})
    for name, k in (("a", 1), ("b", 2)):
        archive(f"{drop}/y", name, {k: payload(f"Book {k}")})
        archive(f"{drop}/z", name, {k: payload(f"Other {k}")})
    path = source(drop, "library", {"a": [line(1, "1")], "b": [line(2, "2")], "c": [line(9, "9", deleted="1")]})
    assert ingest.infer_root(spark, path) == f"{drop}/y"
    r = ingest.scan(spark, path, None, f"{drop}/root", "s1", F.lit("2024-01-01").cast("timestamp")).first()
    assert r.records_added == 2
    os.mkdir(f"{drop}/none")
    assert ingest.infer_root(spark, source(f"{drop}/none", "other", {"q": [line(1, "1")]})) == f"{drop}/none"


def test_covers_over_their_budget_refuse_a_scan(spark, drop):  # noqa: F811
    art = '<coverpage><image l:href="#c.png"/></coverpage>'
    archive(drop, "a", {1: payload("One", extra=art, tail='</p></body><binary id="c.png" content-type="image/png">aGVsbG8=</binary></FictionBook>')})
    path = source(drop, "library", {"a": [line(1, "1")]})
    run = lambda n, limit: ingest.scan(spark, path, drop, f"{drop}/root", n, F.lit("2024-01-01").cast("timestamp"), cover_budget=limit)
    with pytest.raises(Rejected, match="covers need 5 bytes, 4 are allowed"):
        run("s1", 4)
    assert run("s2", 5).first().records_added == 1


def test_progress_keeps_the_newest_event_of_each_job(spark, folder):
    """Files come one after another, with late and repeated events and a restart between; the state is the batch query's."""
    schema = "job long, step int, at int, state string"
    files = [
        [(1, 1, 10, "running"), (1, 2, 20, "running"), (2, 1, 5, "running")],
        [(1, 1, 10, "running"), (1, 1, 15, "late"), (2, 2, 9, "done"), (3, 1, 1, "running")],
        [(1, 2, 20, "running"), (3, 1, 0, "late")],
        [(3, 2, 7, "done"), (1, 3, 30, "done")],
    ]
    os.mkdir(f"{folder}/events")
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{folder}/w{k}")
        (part,) = (f for f in os.listdir(f"{folder}/w{k}") if f.endswith(".json"))
        os.rename(f"{folder}/w{k}/{part}", f"{folder}/events/{k}.json")
        if k % 2:  # two files wait for each start
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{folder}/events")
            progress.follow(spark, stream, f"{folder}/state", f"{folder}/checkpoint", "job", ["at"]).awaitTermination()
            seen = spark.read.schema(schema).json(f"{folder}/events")
            want = latest_per_job(seen, "job", ["at"]).select("job", "step", "at", "state")
            assert sorted(map(tuple, progress.latest(spark, f"{folder}/state").select("job", "step", "at", "state").collect())) == sorted(map(tuple, want.collect()))
