"""Catalogue segments: a Python data source over their ZIP files, lines, and records of 15 fields."""

from __future__ import annotations

import hashlib
import io
import json
import re
import zipfile

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lectern.functions.fields import author_from_inpx, blank_to_null, entry_name, lower_ascii, strict_int, trim_ascii
from lectern.functions.text import decode_segment

# Fixed values of the format.
SEPARATOR, FIELDS = "\u0004", 15
MAX_ENTRY, MAX_LINE = 128 << 20, 1 << 20
#: Bytes of all entries of a source.
MAX_SOURCE = 16 << 30
MAX_AUTHORS, MAX_LIST, MAX_EXTENSION, MAX_INTEGER = 256, 512, 32, 32

SEGMENT_SCHEMA = "inp_entry_name string, archive_name string, segment_order long, fingerprint string, content binary"


def open_file(uri: str):
    """A seekable file of any store that pyarrow knows."""
    uri = re.sub("^file:/+", "/", uri)
    fs, path = pafs.FileSystem.from_uri(uri)
    f = fs.open_input_file(path)
    # zipfile looks for a file's end beyond the start of very small ones
    return io.BytesIO(f.read()) if f.size() < 1 << 16 else f


class _Entry(InputPartition):
    def __init__(self, name: str, order: int):
        self.name, self.order = name, order


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.most, self.total = options["path"], int(options.get("maxEntryBytes", MAX_ENTRY)), int(options.get("maxSourceBytes", MAX_SOURCE))
        self.only = json.loads(options["entries"]) if "entries" in options else None

    def partitions(self):
        with open_file(self.path) as f, zipfile.ZipFile(f) as z:
            names = [i for i in z.infolist() if i.filename.lower().endswith(".inp")]
        if large := [i.filename for i in names if i.file_size > self.most]:
            raise ValueError(f"entries over {self.most} bytes: {large}")
        if sum(i.file_size for i in names) > self.total:
            raise ValueError(f"the source's entries have over {self.total} bytes")
        return [_Entry(i.filename, k) for k, i in enumerate(names) if self.only is None or i.filename in self.only]

    def read(self, partition):
        if partition is None:  # what Spark asks for where there are no partitions
            return
        with open_file(self.path) as f, zipfile.ZipFile(f) as z:
            content = z.read(partition.name)
        base = re.sub(r"(?i)\.inp$", "", re.split(r"[/\\]", partition.name)[-1])
        yield partition.name, base, partition.order, "sha256:" + hashlib.sha256(content).hexdigest(), content


class InpxSource(DataSource):
    """format("inpx"): a row for each `*.inp` entry of a ZIP, in its order; a task for each. A damaged entry fails.

    Options: entries, a JSON list of the names to read; maxEntryBytes, maxSourceBytes.
    """

    @classmethod
    def name(cls):
        return "inpx"

    def schema(self):
        return SEGMENT_SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def read_segments(spark: SparkSession, path: str, entries: list[str] | None = None) -> DataFrame:
    """All segments of a source, or those of the given names."""
    spark.dataSource.register(InpxSource)
    reader = spark.read.format("inpx")
    return (reader if entries is None else reader.option("entries", json.dumps(entries))).load(path)


def segment_names(path: str) -> list[str]:
    """Names of a source's segments in their order, from its directory alone."""
    with open_file(path) as f, zipfile.ZipFile(f) as z:
        return [i.filename for i in z.infolist() if i.filename.lower().endswith(".inp")]


def source_fingerprint(path: str) -> str:
    """Hash of a source's file, read in blocks."""
    found = hashlib.sha256()
    with open_file(path) as f:
        while block := f.read(1 << 20):
            found.update(block)
    return "sha256:" + found.hexdigest()


def lines(segments: DataFrame, text: str) -> DataFrame:
    """segments with line_no (from 1, empty lines count) and line, without empty lines and one trailing carriage return. A line over 1 MiB fails."""
    rows = segments.select("*", F.posexplode(F.split(F.col(text), "\n")).alias("_pos", "_line")).drop(text)
    line = F.regexp_replace("_line", "\r$", "")
    guarded = F.when(F.octet_length(line) > MAX_LINE, F.raise_error(F.lit("a line is over 1 MiB"))).otherwise(line)
    return rows.withColumns({"line_no": F.col("_pos") + 1, "line": guarded}).drop("_pos", "_line").filter("line <> ''")


def _items(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ":"), trim_ascii), lambda x: x != "")


def records(rows: DataFrame) -> DataFrame:
    """rows (with line) and: reject_reason, null for a record; record, null for a reject; warnings.

    Reasons are tried in a fixed order; the first that holds is given. Rows that bring a reason keep it.
    """
    f = F.split("line", SEPARATOR, -1)
    part = lambda i: trim_ascii(F.get(f, i))
    authors = F.filter(F.transform(F.split(F.get(f, F.lit(0)), ":"), trim_ascii), lambda x: x != "")
    named = F.transform(authors, author_from_inpx)
    size, deleted = F.when(part(6).rlike(f"^[0-9]{{1,{MAX_INTEGER}}}$"), part(6).try_cast("decimal(20,0)")), part(8)
    too_large = F.lit("18446744073709551615").cast("decimal(20,0)")
    reason = (
        F.when(F.size(f) != FIELDS, "field-count")
        .when((part(5) == "") | (part(7) == ""), "no-file-or-id")
        .when(size.isNull() | (size > too_large), "size")
        .when((deleted != "") & strict_int(deleted).isNull(), "deleted-flag")
        .when(F.octet_length(part(9)) > MAX_EXTENSION, "long-extension")
        .when(F.size(F.split(F.get(f, F.lit(0)), ":")) > MAX_AUTHORS, "many-authors")
        .when(F.exists(named, lambda a: a.isNull()), "author-parts")
        .when(F.size(F.split(F.get(f, F.lit(1)), ":")) > MAX_LIST, "many-genres")
        .when(F.size(F.split(F.get(f, F.lit(13)), ":")) > MAX_LIST, "many-keywords")
    )
    ext = F.coalesce(F.nullif(lower_ascii(part(9)), F.lit("")), F.lit("fb2"))
    record = F.struct(
        named.alias("authors"),
        _items(F.get(f, F.lit(1))).alias("genres"),
        F.coalesce(F.nullif(part(2), F.lit("")), part(5)).alias("title"),
        blank_to_null(F.get(f, F.lit(3))).alias("series"),
        strict_int(part(4)).alias("series_no"),
        part(5).alias("file"),
        size.alias("size"),
        part(7).alias("lib_id"),
        (F.coalesce(strict_int(deleted), F.lit(0)) != 0).alias("deleted"),
        ext.alias("ext"),
        entry_name(part(5), part(9)).alias("entry_name"),
        blank_to_null(F.get(f, F.lit(10))).alias("date_added"),
        part(11).alias("language"),
        _items(F.get(f, F.lit(13))).alias("keywords"),
    )
    ignored = F.when((part(4) != "") & strict_int(part(4)).isNull(), F.array(F.lit("series-number-ignored"))).otherwise(F.array().cast("array<string>"))
    given = F.col("reject_reason") if "reject_reason" in rows.columns else F.lit(None).cast("string")
    out = rows.withColumn("reject_reason", F.when(given.isNotNull(), given).otherwise(reason))
    ok = F.col("reject_reason").isNull()
    return out.withColumns({"record": F.when(ok, record), "warnings": F.when(ok, ignored).otherwise(F.array("reject_reason"))})


def parse_all(spark: SparkSession, path: str, entries: list[str] | None = None) -> DataFrame:
    """Records and rejects of all segments of a source, or of those of the given names.

    A segment whose bytes have no text is one reject, with line_no 0 and no line, that says why.
    """
    decoded = read_segments(spark, path, entries).withColumn("_d", decode_segment(F.col("content"))).drop("content")
    own = decoded.select("*", "_d.text", F.col("_d.problem").alias("reject_reason")).drop("_d")
    sound = lines(own.filter("reject_reason is null"), "text")
    broken = own.filter("reject_reason is not null").drop("text").withColumns({"line_no": F.lit(0), "line": F.lit(None).cast("string")})
    return records(sound.unionByName(broken))


def unreadable(parsed: DataFrame) -> DataFrame:
    """(inp_entry_name, reject_reason) of segments that have no text."""
    return parsed.filter("line_no = 0").select("inp_entry_name", "reject_reason")


def summary(parsed: DataFrame) -> DataFrame:
    """Records, skipped and warnings of each segment."""
    ok = F.col("reject_reason").isNull()
    return parsed.groupBy("inp_entry_name").agg(F.count("*").alias("records"), F.count_if(~ok).alias("skipped"), F.count_if(ok & F.col("record.deleted")).alias("deleted"), F.sum(F.size("warnings")).alias("warnings"))


def write_inpx(path: str, segments: dict[str, bytes]) -> None:
    """A ZIP of segments, for small exports and tests."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in segments.items():
            z.writestr(name, content)
    with open(path, "wb") as f:
        f.write(buffer.getvalue())
