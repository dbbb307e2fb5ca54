"""Versions of the catalogue's tables: immutable files, changes merged on reading, and commits that can't overwrite each other (K1, ST1, ST6).

A version is a small file that names, for each table, its parts in order: a part has rows, keys that are gone, or both.
What a version doesn't change, the next one names again, so a scan writes what it changed and nothing else. A row is
alive if no later part says that its key is gone, or, where a table's rows replace earlier ones, has the key itself. A
table whose parts become many, or large beside its first one, is written anew.

Versions are numbered. A commit creates the file of the number after its base, and fails if somebody else has; readers
take the largest number once and see its files whatever is published meanwhile.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.quality import Rejected
from lectern.operators.search import live_blocks
from lectern.storage import delete

#: Parts of a table at most, and bytes of its later parts as a share of its first one's at most, before it is written anew.
MOST_PARTS, MOST_CHANGED = 8, 0.5


class Conflict(Rejected):
    """Another scan published since this one began."""


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _size(spark: SparkSession, path: str) -> int:
    at, fs = _path(spark, path)
    return fs.getContentSummary(at).getLength()


def numbers(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the versions that are published, ascending."""
    at, fs = _path(spark, f"{root}/versions")
    if not fs.exists(at):
        return []
    return sorted(int(f.getPath().getName().split(".")[0]) for f in fs.listStatus(at) if f.getPath().getName()[0].isdigit())


def _file(root: str, number: int) -> str:
    return f"{root}/versions/{number:012d}.json"


@dataclass(frozen=True)
class Version:
    """A published state of all tables."""

    spark: SparkSession
    root: str
    number: int
    snapshot: str
    tables: dict[str, dict] = field(repr=False)

    def table(self, name: str) -> DataFrame:
        return merged(self.spark, self.root, self.tables[name])


def opened(spark: SparkSession, root: str, number: int | None = None) -> Version | None:
    """A version, the last one by default; None if there is none."""
    number = number or next(reversed(numbers(spark, root)), None)
    if number is None:
        return None
    found = json.loads(spark.read.text(_file(root, number), wholetext=True).first().value)
    return Version(spark, root, number, found["snapshot"], found["tables"])


def current(spark: SparkSession, root: str) -> str | None:
    """The published snapshot's id, or None."""
    last = opened(spark, root)
    return last and last.snapshot


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the last version. A query of several tables should open the version once."""
    last = opened(spark, root)
    if last is None:
        raise LookupError(f"{root} has no published snapshot")
    return last.table(name)


def merged(spark: SparkSession, root: str, spec: dict) -> DataFrame:
    """The live rows of a table's parts: one join with the keys that are gone, however many parts there are."""
    parts, key = spec["parts"], spec["key"]
    read = lambda path: spark.read.parquet(f"{root}/{path}")
    rows = [read(p["rows"]).withColumn("_seq", F.lit(i)) for i, p in enumerate(parts) if p.get("rows")]
    every = reduce(DataFrame.unionByName, rows)
    if spec.get("blocks"):
        gone = [read(p["gone"]).withColumn("_at", F.lit(i)) for i, p in enumerate(parts) if p.get("gone")]
        return live_blocks(every, reduce(DataFrame.unionByName, gone) if gone else None)
    gone = [read(p["gone"]).select(key, F.lit(i).alias("_at")) for i, p in enumerate(parts) if i and p.get("gone")]
    if spec["replaces"]:
        gone += [read(p["rows"]).select(key, F.lit(i).alias("_at")) for i, p in enumerate(parts) if i and p.get("rows")]
    if gone:
        last = reduce(DataFrame.unionByName, gone).groupBy(key).agg(F.max("_at").alias("_at"))
        every = every.join(last, key, "left").filter("_at is null or _at <= _seq").drop("_at")
    return every.drop("_seq")


class Draft:
    """A version in the making. Its tables can be read as they will be; nobody else sees them before commit()."""

    def __init__(self, spark: SparkSession, root: str, snapshot: str):
        self.spark, self.root, self.snapshot = spark, root, snapshot
        self.base = opened(spark, root)
        self.tables = dict(self.base.tables) if self.base else {}
        # a folder of its own: a scan that is repeated, or runs beside another, overwrites nothing
        self.own = f"data/{snapshot}-{uuid.uuid4().hex[:12]}"

    def _write(self, path: str, df: DataFrame) -> str | None:
        """The path, or None if there are no rows."""
        df.write.parquet(f"{self.root}/{path}")
        if self.spark.read.parquet(f"{self.root}/{path}").isEmpty():
            return None
        return path

    def stage(self, name: str, df: DataFrame) -> DataFrame:
        """df written and read back, so that what several tables share is worked out once; it goes with the commit."""
        path = f"{self.root}/{self.own}/_stage/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def old(self, name: str) -> DataFrame | None:
        return self.base.table(name) if self.base else None

    def table(self, name: str) -> DataFrame:
        return merged(self.spark, self.root, self.tables[name])

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """The whole table, where it is small."""
        path = f"{self.own}/{name}"
        df.write.parquet(f"{self.root}/{path}")
        self.tables[name] = {"key": None, "replaces": False, "parts": [{"rows": path}]}
        return self.table(name)

    def change(self, name: str, key: str, rows: DataFrame, gone: DataFrame | None = None, replaces: bool = True, blocks: bool = False) -> DataFrame:
        """A table with more rows, which replace those of the same key, and without the rows of keys that are gone. With blocks, gone has ids of blocks."""
        if name not in self.tables:
            path = f"{self.own}/{name}/rows"
            rows.write.parquet(f"{self.root}/{path}")
            self.tables[name] = {"key": key, "replaces": replaces, "blocks": blocks, "parts": [{"rows": path}]}
            return self.table(name)
        part = {"rows": self._write(f"{self.own}/{name}/rows", rows), "gone": None if gone is None else self._write(f"{self.own}/{name}/gone", gone)}
        spec = self.tables[name]
        if part["rows"] or part["gone"]:
            spec = self.tables[name] = spec | {"parts": [*spec["parts"], {k: v for k, v in part.items() if v}]}
        self._compact(name, spec)
        return self.table(name)

    def _compact(self, name: str, spec: dict) -> None:
        first, later = spec["parts"][0], spec["parts"][1:]
        if not later:
            return
        large = sum(_size(self.spark, f"{self.root}/{path}") for p in later for path in p.values()) > MOST_CHANGED * _size(self.spark, f"{self.root}/{first['rows']}")
        if large or len(later) >= MOST_PARTS:
            path = f"{self.own}/{name}/whole"
            merged(self.spark, self.root, spec).write.parquet(f"{self.root}/{path}")
            self.tables[name] = spec | {"parts": [{"rows": path}]}

    def commit(self, checks: list[Callable[[dict[str, DataFrame]], DataFrame]] = ()) -> Version:
        """Runs the checks on the written tables and publishes them, or refuses and leaves what was. A version that was published since the draft began refuses it, too."""
        try:
            tables = {name: self.table(name) for name in self.tables}
            for check in checks:
                if broken := check(tables).head(1):
                    raise Rejected(f"snapshot {self.snapshot} is refused: {broken[0]}")
            number = self.base.number + 1 if self.base else 1
            content = json.dumps({"snapshot": self.snapshot, "base": number - 1, "tables": self.tables}, sort_keys=True)
            if not create(self.spark, _file(self.root, number), content.encode()):
                raise Conflict(f"version {number} was published by another scan")
        except BaseException:
            self.drop()
            raise
        delete(self.spark, f"{self.root}/{self.own}/_stage")
        return Version(self.spark, self.root, number, self.snapshot, self.tables)

    def drop(self) -> None:
        """Deletes what the draft wrote."""
        delete(self.spark, f"{self.root}/{self.own}")


def create(spark: SparkSession, path: str, content: bytes) -> bool:
    """Writes a whole file under a name that must be new; False if it isn't. Of several writers at once one succeeds.

    The file is written beside its name and gets it by a step that the file system does only where the name is free: a
    rename without overwriting, or a link on a local file system, whose renames overwrite.
    """
    jvm = spark._jvm
    at, fs = _path(spark, path)
    draft, _ = _path(spark, f"{at.getParent()}/.{at.getName()}-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(content)
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            names = [jvm.java.io.File(p.toUri().getPath()).toPath() for p in (at, draft)]
            jvm.java.nio.file.Files.createLink(*names)
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
            options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            context.rename(fs.makeQualified(draft), fs.makeQualified(at), options)
    except Py4JJavaError as e:
        if fs.exists(at):
            return False
        raise e
    finally:
        fs.delete(draft, False)
    return True


def expire(spark: SparkSession, root: str, keep: int = 10) -> list[str]:
    """Deletes all but the last `keep` versions, and the files that only they name; returns the folders. Drafts aren't touched."""
    known = numbers(spark, root)
    files = lambda n: {path for spec in opened(spark, root, n).tables.values() for p in spec["parts"] for path in p.values()}
    old, kept = known[:-keep], known[-keep:]
    gone = set().union(*map(files, old)) - set().union(*map(files, kept)) if old else set()
    for number in old:
        delete(spark, _file(root, number))
    for path in gone:
        delete(spark, f"{root}/{path}")
    return sorted(gone)
