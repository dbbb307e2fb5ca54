"""ZIP archives: manifests and payloads."""

from __future__ import annotations

import json
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .inpx import open_file

#: Payloads of more bytes are refused.
MAX_PAYLOAD = 250 << 20
#: Archives of more entries, or of more bytes once unpacked, are refused.
MAX_ENTRIES, MAX_UNPACKED = 1_000_000, 1 << 40
#: Bytes of payloads that are handed on at once; a larger one is alone.
BATCH = 16 << 20


class _Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.entries, self.unpacked = int(options.get("maxEntries", MAX_ENTRIES)), int(options.get("maxBytes", MAX_UNPACKED))
        self.validate = str(options.get("validate", "false")).lower() == "true"

    def partitions(self):
        return [_Archive(p) for p in self.paths]

    def read(self, partition):
        if partition is None:  # what Spark asks for where there are no partitions
            return
        with open_file(partition.path) as f, zipfile.ZipFile(f) as z:
            found = z.infolist()
            if len(found) > self.entries or sum(i.file_size for i in found) > self.unpacked:
                raise ValueError(f"{partition.path} has over {self.entries} entries or {self.unpacked} bytes")
            for i in found:
                seen, crc = None, None
                if self.validate:
                    seen, crc = 0, 0
                    try:
                        with z.open(i) as payload:
                            while part := payload.read(1 << 20):
                                seen, crc = seen + len(part), zlib.crc32(part, crc)
                    except (zipfile.BadZipFile, zlib.error, EOFError):
                        crc = None
                yield partition.path, i.filename, i.file_size, i.CRC, seen, None if not self.validate else crc == i.CRC and seen == i.file_size


class ZipManifest(DataSource):
    """format("zip_manifest"): name, size and CRC of each entry from the central directory; a task for each archive.

    The archives are the path, or the JSON list in the option paths. Option validate also reads every payload and tells
    whether its length and CRC hold; maxEntries and maxBytes bound an archive.
    """

    @classmethod
    def name(cls):
        return "zip_manifest"

    def schema(self):
        return "archive string, name string, size long, crc long, payload_bytes long, payload_ok boolean"

    def reader(self, schema):
        return _Reader(self.options)


def manifests(spark: SparkSession, paths: list[str], validate: bool = False) -> DataFrame:
    spark.dataSource.register(ZipManifest)
    return spark.read.format("zip_manifest").option("validate", validate).option("paths", json.dumps(paths)).load()


def file_states(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, modified) of the archives under root; their content isn't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def _payloads(batches):
    """Batches of about BATCH bytes; an archive is opened once for the entries that follow each other."""
    opened: tuple[str, zipfile.ZipFile] | None = None
    held, size = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            if opened is None or opened[0] != row["archive"]:
                opened = row["archive"], zipfile.ZipFile(open_file(row["archive"]))
            try:
                info = opened[1].getinfo(row["entry"])
            except KeyError:
                raise ValueError(f"{row['archive']} has no entry {row['entry']}") from None
            if info.file_size > MAX_PAYLOAD:
                raise ValueError(f"{row['entry']} is over {MAX_PAYLOAD} bytes")
            if held and size + info.file_size > BATCH:
                yield pa.RecordBatch.from_pylist(held)
                held, size = [], 0
            held.append(row | {"content": opened[1].read(info)})
            size += info.file_size
    if held:
        yield pa.RecordBatch.from_pylist(held)


def payloads(wanted: DataFrame) -> DataFrame:
    """(archive, entry, content) of (archive, entry). Tasks have runs of entries that follow each other, so a large archive takes several tasks, and each opens it once."""
    tasks = max(1, int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # with a given number of ranges the plan keeps them apart, small as the names are beside what they stand for
    dealt = wanted.select("archive", "entry").repartitionByRange(tasks, "archive", "entry").sortWithinPartitions("archive", "entry")
    return dealt.mapInArrow(_payloads, "archive string, entry string, content binary")


def first_names(names: DataFrame, order: str, most: int) -> DataFrame:
    """(archive, pos): the first distinct archives in the order of their first rows; a bounded sample (S5). names: (archive, order)."""
    first = names.groupBy("archive").agg(F.min(order).alias("_o")).orderBy("_o").limit(most)
    return first.select("archive", F.row_number().over(Window.orderBy("_o")).alias("pos"))


def best_root(samples: DataFrame, candidates: DataFrame, listing: DataFrame) -> DataFrame:
    """(candidate, found): the folder that holds most of the sampled archives; the first of equals.

    samples: (archive), a bounded sample; candidates: (candidate, ord); listing: (candidate, archive).
    """
    held = listing.join(samples, "archive", "left_semi").groupBy("candidate").agg(F.count_distinct("archive").alias("found"))
    return candidates.join(held, "candidate", "left").select("candidate", "ord", F.coalesce("found", F.lit(0)).alias("found")).orderBy(F.desc("found"), "ord").limit(1).select("candidate", "found")


def resolve_archives(names: DataFrame, listing: DataFrame) -> DataFrame:
    """(archive, folder): the root's own file, else the first folder in byte order that has it. listing: (folder, archive), '' for the root."""
    place = F.struct((F.col("folder") != "").cast("int").alias("p"), F.col("folder"))
    found = listing.groupBy("archive").agg(F.min(place).alias("m")).select("archive", F.col("m.folder").alias("folder"))
    return names.join(found, "archive", "left")
