"""WARC archives: a writer, and a sequential reader (operator 6).

Every record is one gzip member. The reader inflates a file bit by bit, takes a record's header lines up to the blank
line, then exactly as many bytes as Content-Length says, checks that the record's two line ends and its member end there,
and verifies the block's and the payload's SHA-1. Equal payloads are stored once: the record with the largest page id is
the response, the others are revisit records that name it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, look_up, map_batches, new_folder, sliced

#: Payloads of fewer bytes are always stored.
LEAST_SHARED = 1000
CHUNK = 1 << 16
MAX_HEADER = 1 << 20
DATE = "2024-01-01T00:00:00Z"

# Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http;msgtype=response"


def _digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def _hex(digest: str) -> str:
    return base64.b32decode(digest.removeprefix("sha1:")).hex()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE, own: str = "0") -> bytes:
    """One record as a gzip member. With refers_to it is a revisit and its block holds the HTTP header only. own tells records of one page id, or of none, apart."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:x-page:{'' if page_id is None else page_id}:{own}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", url and quote(url, safe=":/?#[]@!$&'()*+,;=%~-._")),
        ("WARC-Payload-Digest", _digest(payload)),
        ("WARC-Block-Digest", _digest(block)),
        ("WARC-Refers-To", None if refers_to is None else f"<urn:x-page:{refers_to}>"),
        ("WARC-Profile", None if refers_to is None else REVISIT_PROFILE),
        ("Content-Type", HTTP_TYPE),
        ("Content-Length", str(len(block))),
    ]
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields if v is not None) + b"\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


class _Members:
    """Bytes of one gzip member after another, inflated as they are asked for."""

    def __init__(self, source):
        self.source, self.raw, self.ready, self.inflate = source, b"", b"", None

    def more(self) -> bool:
        """Whether another member begins."""
        self.raw = self.raw or self.source.read(CHUNK)
        self.inflate, self.ready = zlib.decompressobj(31), b""
        return bool(self.raw)

    def _fill(self) -> bool:
        if self.inflate.eof:
            return False
        self.raw = self.raw or self.source.read(CHUNK)
        if not self.raw:
            raise ValueError("the file ends inside a record")
        self.ready += self.inflate.decompress(self.raw, CHUNK)
        self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        while (at := self.ready.find(mark)) < 0:
            if len(self.ready) > MAX_HEADER or not self._fill():
                raise ValueError("a record has no end of its header")
        out, self.ready = self.ready[:at], self.ready[at + len(mark) :]
        return out

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.ready and not self._fill():
                raise ValueError("a record is shorter than its Content-Length")
            part, self.ready = self.ready[:n], self.ready[n:]
            n -= len(part)
            yield part

    def close(self) -> None:
        while self._fill():
            if len(self.ready) > 4:
                break
        if self.ready != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its Content-Length says")


def read_records(source) -> Iterator[dict]:
    """Records of a file object: header fields (names in lower case), `payload`, `payload_bytes` as the HTTP header states, `digest_ok`.

    A malformed record raises ValueError; a wrong digest only sets digest_ok to false.
    """
    members = _Members(source)
    while members.more():
        head = members.until(b"\r\n\r\n").split(b"\r\n")
        if not head[0].startswith(b"WARC/"):
            raise ValueError("a record has no WARC version line")
        fields = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (line.partition(b":") for line in head[1:])}
        block = b"".join(members.exactly(int(fields["content-length"])))
        members.close()
        http, _, payload = block.partition(b"\r\n\r\n")
        stated = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
        good = _digest(block) == fields.get("warc-block-digest", _digest(block))
        if fields["warc-type"] == "response":
            good = good and len(payload) == stated and _digest(payload) == fields.get("warc-payload-digest", _digest(payload))
        yield fields | {"payload": payload, "payload_bytes": stated, "digest_ok": good}


def _page(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:x-page:").removesuffix(">").split(":")[0]
    return int(digits) if digits else None


def _writer(folder: str):
    def run(batches):
        fs, where = pafs.FileSystem.from_uri(folder)
        fs.create_dir(where, recursive=True)
        # the attempt's own name: only what the manifest lists counts, and Spark commits one attempt's row of it
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        count = 0
        with fs.open_output_stream(f"{where}/{name}", compression=None) as out:
            for batch in sliced(batches, "html"):
                for r in batch.to_pylist():
                    out.write(record(r["page_id"], r["url"], (r["html"] or "").encode(), r["refers_to"], own=f"{name[5:-8]}-{count}"))
                    count += 1
        yield pa.RecordBatch.from_pylist([{"file": name, "records": count}])

    return run


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Writes an archive for each partition of pages (page_id, url, html) and a manifest (file, records), which it returns."""
    pages = pages.select(F.col("page_id").cast("long"), "url", "html")
    html = F.coalesce("html", F.lit(""))
    known = pages.withColumns({"digest": F.sha1(html.cast("binary")), "shared": F.octet_length(html) >= LEAST_SHARED})
    # only payloads that occur again; the aggregate is combined before it is shuffled, so copies cost a row a task
    first = cut(known.filter("shared").groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).filter("n > 1"), "copies")
    refers = F.expr("case when page_id <> response or (page_id is null and response is not null) then response end").alias("refers_to")
    # small payloads, of which very many may be equal, have no key
    placed = look_up(known.withColumn("digest", F.when(F.col("shared"), F.col("digest"))), first, "digest").select("page_id", "url", "html", refers)
    map_batches(placed, _writer(folder), "file string, records long").write.mode("overwrite").parquet(f"{folder}/manifest")
    drop(first)
    return pages.sparkSession.read.parquet(f"{folder}/manifest")


def _reader(folder: str):
    def run(batches):
        fs, where = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                with fs.open_input_stream(f"{where}/{name}", compression=None) as f:
                    for r in read_records(f):
                        rows.append({"page_id": _page(r["warc-record-id"]), "payload_bytes": r["payload_bytes"], "payload_digest": _hex(r["warc-payload-digest"]), "record_type": r["warc-type"], "refers_to": _page(r.get("warc-refers-to")), "digest_ok": r["digest_ok"]})
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_pylist(rows, _RECORDS)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, _RECORDS)

    return run


_RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest_ok", pa.bool_())])


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, digest_ok) of every record, a task for each file or more."""
    manifest = spark.read.parquet(f"{folder}/manifest").filter("records > 0").select("file")
    return manifest.repartition(max(1, spark.sparkContext.defaultParallelism * 4), "file").mapInArrow(
        _reader(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, digest_ok boolean"
    )


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes all pages to archives in the shared folder and returns what read_warc() finds there.

    Null html is an empty payload; rows that repeat a page id are each written, and count as the response if their id is the
    largest; a row without an id is the response unless an equal payload has an id; long payloads are whole; an empty table
    gives no records. Other columns are ignored.
    """
    folder = new_folder(pages.sparkSession, "warc")
    write_warc(pages, folder)
    return read_warc(pages.sparkSession, folder)


ORACLE = """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
     q as (select *, max(page_id) over (partition by payload_digest) as top from p)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 1000 and page_id <> top then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id <> top then top end as refers_to
from q
"""
