"""Helpers shared by the training-data operators: shared folders, lineage cuts, Arrow batches."""

from __future__ import annotations

import hashlib
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.lookup import look_up  # noqa: F401
from lectern.storage import cut, delete, drop, new_folder, shared_dir  # noqa: F401

#: Bytes of text that one numpy pass works on; it bounds a task's memory, not the input.
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch, about.
BATCH_BYTES = 4 << 20


def map_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """df.mapInArrow() over batches of bounded bytes, not of rows alone; a longer row is a batch of its own."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


#: Spark removes a query's shuffle files at its end where this is on.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Tables that cut() writes inside leave no shuffle files, so that a job of many steps needs the disk of its largest step."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def bucket_of(column: str, mod: int):
    """crc32 of the id as text, modulo mod: the split into learning and held-out rows."""
    return F.crc32(F.col(column).cast("string")) % mod


def text_column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty. Offsets start at 0."""
    col = batch.column(name)
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    if len(offsets) == 0:
        offsets = np.zeros(1, dtype=np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def sliced(batches, name: str, limit: int = SLICE_BYTES):
    """Cuts Arrow batches into runs of whole rows of about `limit` bytes of column `name`; a longer row stands alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = text_column(batch, name)
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
#: Bytes of a block of span_hashes(); powers of the base begin anew in each.
_BLOCK = 1 << 18
#: Polynomials modulo 2^64 have known collisions from some 1,024 bytes on, whatever the base; longer spans than this are hashed by BLAKE2 instead.
_LONG = 256


@lru_cache(maxsize=1)
def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse, for the places of a block."""
    tables = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(_BLOCK + 1, base, dtype=np.uint64)
        steps[0] = 1
        tables.append(np.multiply.accumulate(steps))
    return tables[0], tables[1]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first) of words [^\\x20\\x09-\\x0D]+: byte spans, and the first word's number for each row, with the total at the end."""
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = ~_SPACE[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside[:-1]
    before[offsets] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data) + 1, dtype=bool)
    after[:-1] = inside[1:]
    after[offsets[1:] - 1] = False
    if len(data):
        ends = np.flatnonzero(inside & ~after) + 1
    else:
        ends = starts
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans with ascending starts: differences of a running polynomial, scaled back to position 0; BLAKE2 for long ones."""
    up, down = _power_tables()
    out = np.empty(len(starts), np.uint64)
    blocks = range(0, len(data), _BLOCK)
    first = np.searchsorted(starts, [*blocks, len(data)]).tolist()
    for b, lo, hi in zip(blocks, first[:-1], first[1:], strict=True):
        if lo == hi:
            continue
        part = data[b : b + _BLOCK]
        running = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUE[part] * up[: len(part)], out=running[1:])
        begin, end = starts[lo:hi] - b, ends[lo:hi] - b
        out[lo:hi] = (running[np.minimum(end, len(part))] - running[begin]) * down[begin]
        for i in (lo + np.flatnonzero((end > len(part)) & (end - begin <= _LONG))).tolist():
            at, total = b + len(part), int(out[i])
            while at < ends[i]:
                more = data[at : min(at + _BLOCK, int(ends[i]))]
                own = int(np.sum(_BYTE_VALUE[more] * up[: len(more)], dtype=np.uint64))
                total += own * pow(_BASE, at - int(starts[i]), 1 << 64)
                at += len(more)
            out[i] = np.uint64(total & (1 << 64) - 1)
        for i in (lo + np.flatnonzero(end - begin > _LONG)).tolist():
            out[i] = np.frombuffer(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), np.uint64)[0]
    tail = first[-1]
    out[tail:] = 0  # empty spans at the end of the data
    return mix(out + (ends - starts).astype(np.uint64))


def words(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words of a text column, and each row's first word number, with the total at the end."""
    data, offsets = text_column(batch, name)
    data = _LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    return span_hashes(data, starts, ends), first


def binary_views(column: pa.Array, kind: type) -> list[np.ndarray]:
    """The values of a binary column as arrays over its own buffer."""
    if not len(column):
        return []
    _, places, data = column.buffers()
    at = np.frombuffer(places, np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    raw = memoryview(data) if data is not None else b""
    return [np.frombuffer(raw[a:b], kind) for a, b in zip(at[:-1], at[1:], strict=True)]


def most_frequent(counted: DataFrame, size: int, key: str) -> Column:
    """A condition that holds for about `size` rows of counted (columns key, n) with the largest counts, or for all if there are fewer.

    Counts fall into classes, eight to each doubling. The classes' sizes, a few hundred numbers, tell which of them fit;
    so no row has to be ranked. Of the first class that doesn't fit whole, rows are taken by their keys' hashes.
    """
    step = F.floor(F.log2("n") * 8).cast("int")
    left, rule = size, F.lit(False)
    for r in sorted(counted.groupBy(step.alias("step")).agg(F.count("*").alias("k")).collect(), reverse=True):
        if r.k > left:
            return rule | ((step == r.step) & (F.pmod(F.xxhash64(key), F.lit(r.k)) < left))
        rule, left = step >= r.step, left - r.k
    return rule
