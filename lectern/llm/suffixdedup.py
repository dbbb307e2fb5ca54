"""Removal of repeated text by suffix order, bucket by bucket (operator 12).

A byte goes if a string of WINDOW bytes around it starts earlier, too, in a document with a smaller id or further up in
its own. Equal strings must meet without every suffix being sent, so:

1. Each window of WINDOW bytes names its anchor, the 16 bytes in it with the least hash. Neighbouring windows mostly share
   one, so a document is a chain of *stretches*: a stretch has some forty windows and is told by its anchor's hash and a
   digest of its bytes. Equal windows have equal anchors at equal places.
2. Of equal stretches the earliest stays; the windows of the others start earlier, all of them. Each task settles its own
   copies before the shuffle, so a passage that a third of all documents hold sends one row a task.
3. Only where an anchor has several different stretches must their windows be compared. Their texts meet by anchor, in
   shares of at most about GROUP stretches, and a task sorts them in blocks: `suffixes.py` sorts one suffix bucket at a
   time and resolves long ties by the ranks of a difference-cover sample, so memory is bounded by the block.
4. Where an anchor has several shares, each share's windows that stay meet once more by digest.

Windows found to start earlier are gathered as spans of their document, which meets its text once more for the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, map_batches, mix, shuffles_removed, sliced, text_column
from .suffixes import DEPTH, PAD, Block, ragged

WINDOW = DEPTH
GRAM = 16
#: Places of an anchor in a window.
PLACES = WINDOW - GRAM + 1
#: Bytes of text that one pass looks at; longer texts are looked at in parts that overlap.
PART = 1 << 19
#: Stretches that a task gathers before it settles its own copies.
GATHERED = 1 << 19
#: Stretches of an anchor that meet in one block.
GROUP = 2048
#: Bytes of a block, about. A share is never cut, so a block may have a share more.
BLOCK = 1 << 19
NO_ID = (1 << 63) - 1
INDEX_BITS = 22

STRETCHES = "mark boolean, anchor long, d1 long, d2 long, did long, dup long, start int, size int"
SPANS = "d1 long, d2 long, did long, dup long, start int, size int"


# --- stretches ---------------------------------------------------------------------------------------------------


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on; the last GRAM - 1 ones mean nothing."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(2 * GRAM, np.uint8)])
    words = np.empty(n + 8, np.uint64)
    for k in range(8):
        m = len(range(k, n + 8, 8))
        words[k::8] = np.frombuffer(padded, "<u8", m, k)
    return mix(words[:n] * np.uint64(0x9E3779B97F4A7C15) ^ mix(words[8:]))


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, size, anchor) of the stretches of texts laid side by side: which text, where in all of them, number of windows, hash of the anchor."""
    none = np.zeros(0, np.int64)
    if len(data) < WINDOW:
        return none, none, none, none
    grams = gram_hashes(data)
    low = np.uint64(INDEX_BITS)
    least = (grams >> low << low) | np.arange(len(data), dtype=np.uint64)  # of equal hashes the first one
    reach = 1
    while 2 * reach <= PLACES:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < PLACES:
        least = np.minimum(least[: len(least) - (PLACES - reach)], least[PLACES - reach :])
    least = least[: len(data) - WINDOW + 1]
    at = (least & np.uint64((1 << INDEX_BITS) - 1)).astype(np.int64)
    sizes = np.diff(offsets)
    windows = np.maximum(sizes - WINDOW + 1, 0)
    owned = np.flatnonzero(windows)
    step = np.zeros(len(at) + 1, np.int8)
    step[offsets[:-1][owned]] += 1
    np.subtract.at(step, offsets[:-1][owned] + windows[owned], 1)
    valid = np.cumsum(step[:-1], dtype=np.int8) > 0
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    new[offsets[:-1][owned]] = True
    start = np.flatnonzero(new & valid)
    text = np.searchsorted(offsets, start, side="right") - 1
    end = np.append(start[1:], len(at) + WINDOW)
    end = np.minimum(end, offsets[text] + windows[text])
    return text, start, end - start, grams[at[start]].view(np.int64)


def _digests(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """128-bit digests of spans as two numbers each."""
    view = memoryview(np.ascontiguousarray(data))
    made = [hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), (start + length).tolist(), strict=True)]
    return np.frombuffer(b"".join(made), np.int64).reshape(-1, 2)


def _joined(did: np.ndarray, dup: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of windows in ascending order, those that touch in one document as one."""
    if not len(did):
        return did, dup, start, size
    new = np.ones(len(did), bool)
    new[1:] = (did[1:] != did[:-1]) | (dup[1:] != dup[:-1]) | (start[1:] > start[:-1] + size[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(did)) - 1
    return did[first], dup[first], start[first], start[last] + size[last] - start[first]


def _settled(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """One row for each different stretch of a task, the earliest, and marks for the windows of its copies."""
    anchor, d1, d2, did, dup, start, size = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.lexsort((start, dup, did))
    anchor, d1, d2, did, dup, start, size = (x[order] for x in (anchor, d1, d2, did, dup, start, size))
    by = np.argsort(d1, kind="stable")
    again = np.zeros(len(by), bool)
    again[1:] = np.all([x[by][1:] == x[by][:-1] for x in (anchor, d1, d2)], axis=0)
    first = by[np.maximum.accumulate(np.where(again, 0, np.arange(len(by))))]
    # rows that are repeated whole stand at one place: neither starts earlier
    same_place = np.all([x[by] == x[first] for x in (did, dup, start)], axis=0)
    kept = np.sort(by[~again])
    marks = np.sort(by[again & ~same_place])
    m_did, m_dup, m_start, m_size = _joined(did[marks], dup[marks], start[marks], size[marks])
    n, m = len(kept), len(m_did)
    # marks meet nothing: any spread of them will do
    columns = [
        np.repeat([False, True], [n, m]),
        np.concatenate([anchor[kept], m_start.astype(np.int64)]),
        np.concatenate([d1[kept], m_did]),
        np.concatenate([d2[kept], m_dup]),
        np.concatenate([did[kept], m_did]),
        np.concatenate([dup[kept], m_dup]),
        np.concatenate([start[kept], m_start]).astype(np.int32),
        np.concatenate([size[kept], m_size]).astype(np.int32),
    ]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["mark", "anchor", "d1", "d2", "did", "dup", "start", "size"])


def _parts(data: np.ndarray, offsets: np.ndarray):
    """(bytes, offsets, place of the first byte) of a slice, cut up where it is one long text; parts share WINDOW - 1 bytes."""
    if len(offsets) > 2 or len(data) <= PART:
        yield data, offsets, 0
        return
    for a in range(0, max(1, len(data) - WINDOW + 1), PART):
        part = data[a : a + PART + WINDOW - 1]
        yield part, np.array([0, len(part)]), a


def _stretch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, gathered = [], 0
    for batch in sliced(batches, "text", PART):
        did, dup = (np.asarray(batch.column(n)) for n in ("did", "dup"))
        for data, offsets, first in _parts(*text_column(batch, "text")):
            text, start, size, anchor = stretches(data, offsets)
            if not len(text):
                continue
            digest = _digests(data, start, size + WINDOW - 1)
            rows.append((anchor, digest[:, 0], digest[:, 1], did[text], dup[text], start - offsets[text] + first, size))
            gathered += len(text)
        if gathered >= GATHERED:
            yield _settled(rows)
            rows, gathered = [], 0
    if rows:
        yield _settled(rows)


# --- windows of different stretches with one anchor ------------------------------------------------------------------


def _texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted stretches of each text."""
    for batch in sliced(batches, "text", 4 * PART):
        data, offsets = text_column(batch, "text")
        data = memoryview(np.ascontiguousarray(data))
        wanted = batch.column("wanted")
        own = np.repeat(np.arange(len(batch)), np.diff(wanted.offsets.to_numpy()))
        fields = dict(zip([f.name for f in wanted.type.value_type], wanted.flatten().flatten(), strict=True))
        start, size = (np.asarray(fields[n]).astype(np.int64) for n in ("start", "size"))
        begin = start + offsets[own]
        raw = [data[a:b] for a, b in zip(begin.tolist(), (begin + size + WINDOW - 1).tolist(), strict=True)]
        did, dup = (np.asarray(batch.column(n))[own] for n in ("did", "dup"))
        out = [fields["anchor"], fields["share"], fields["several"], pa.array(did), pa.array(dup), fields["start"], fields["size"], pa.array([bytes(x) for x in raw], pa.binary())]
        yield pa.RecordBatch.from_arrays(out, names=["anchor", "share", "several", "did", "dup", "start", "size", "raw"])


def repeated_windows(raw: list[bytes], size: np.ndarray, did: np.ndarray, dup: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For the windows of the stretches, one after another, whether an equal one of another stretch here starts earlier."""
    begin = np.cumsum([0, *[len(x) + PAD for x in raw]])[:-1]
    data = np.frombuffer(b"".join([x + bytes(PAD) for x in raw]), np.uint8)
    owner = np.repeat(np.arange(len(raw)), size)
    at = ragged(begin, size)
    # windows whose sum of hashes no other one has are told apart at once, and stretches of such windows alone leave the block
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(gram_hashes(data), dtype=np.uint64)])
    slot = (mix(sums[at + PLACES] - sums[at]) >> np.uint64(43)).astype(np.int64)
    maybe = np.bincount(slot, minlength=1)[slot] > 1
    out = np.zeros(len(at), bool)
    live = np.unique(owner[maybe])
    if not len(live):
        return out
    length = size[live] + WINDOW - 1
    moved = np.cumsum(np.append(0, length + PAD))[:-1]
    own = data[ragged(begin[live], length + PAD)]
    shift = np.zeros(len(raw), np.int64)
    shift[live] = moved - begin[live]
    windows = np.flatnonzero(maybe)
    block = Block(own, moved, length)
    order = np.lexsort((start, dup, did))
    document = np.empty(len(raw), np.int64)
    document[order] = np.cumsum(np.append(False, (did[order][1:] != did[order][:-1]) | (dup[order][1:] != dup[order][:-1])))
    place = document[owner[windows]] << 32 | start[owner[windows]] + (at - begin[owner])[windows]
    for members, number in block.equal_classes(at[windows] + shift[owner[windows]]):
        if len(members):
            first = np.minimum.reduceat(place[members], np.flatnonzero(np.append(True, number[1:] != number[:-1])))
            which = np.cumsum(np.append(0, number[1:] != number[:-1]))
            out[windows[members]] = place[members] > first[which]
    return out


def _spans(flags: np.ndarray, size: np.ndarray, did: np.ndarray, dup: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Flagged windows as spans (did, dup, start, size), stretch by stretch."""
    owner = np.repeat(np.arange(len(size)), size)
    at = np.flatnonzero(flags)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])
    first = np.flatnonzero(new)
    own = owner[at[first]]
    place = start[own] + at[first] - (np.cumsum(size) - size)[own]
    return did[own], dup[own], place, np.diff(np.append(first, len(at)))


def _span_batch(did, dup, start, size, digest=None) -> pa.RecordBatch:
    """Marks have no digest; windows that another share may have do."""
    d1, d2 = (pa.nulls(len(did), pa.int64()),) * 2 if digest is None else (pa.array(digest[:, 0]), pa.array(digest[:, 1]))
    return pa.RecordBatch.from_arrays([d1, d2, pa.array(did), pa.array(dup), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))], names=["d1", "d2", "did", "dup", "start", "size"])


def _compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
    raw = table.column("raw").to_pylist()
    size, did, dup, start = (np.asarray(table.column(n)).astype(np.int64) for n in ("size", "did", "dup", "start"))
    flags = repeated_windows(raw, size, did, dup, start)
    yield _span_batch(*_spans(flags, size, did, dup, start))
    several = np.repeat(np.asarray(table.column("several")), size)
    if (several & ~flags).any():
        own_did, own_dup, place, n = _spans(several & ~flags, size, did, dup, start)
        begin = np.cumsum([0, *[len(x) for x in raw]])[:-1]
        at = ragged(begin, size)[several & ~flags]
        digest = _digests(np.frombuffer(b"".join(raw), np.uint8), at, np.full(len(at), WINDOW))
        yield _span_batch(np.repeat(own_did, n), np.repeat(own_dup, n), ragged(place, n), np.ones(len(at), np.int64), digest)


def _sorter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor and share; a block ends between two shares."""
    held, size = [], 0
    for batch in batches:
        start = 0
        anchor, share, length = (np.asarray(batch.column(n)) for n in ("anchor", "share", "size"))
        key = np.stack([anchor, share.astype(np.int64)])
        edges = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        if held and batch.num_rows:
            last = held[-1]
            if (last.column("anchor")[-1].as_py(), last.column("share")[-1].as_py()) != (int(anchor[0]), int(share[0])):
                edges = np.append(0, edges)
        total = np.append(0, np.cumsum(length + WINDOW))
        for edge in edges.tolist():
            if size + total[edge] - total[start] >= BLOCK:
                held.append(batch.slice(start, edge - start))
                yield from _compared(pa.Table.from_batches(held))
                held, size, start = [], 0, edge
        if start < batch.num_rows:
            held.append(batch.slice(start))
            size += total[-1] - total[start]
    if held:
        yield from _compared(pa.Table.from_batches(held))


# --- the result ------------------------------------------------------------------------------------------------------


def covered(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the bytes under spans of windows, joined where they touch or overlap, ascending."""
    if not len(starts):
        return starts, starts
    order = np.argsort(starts, kind="stable")
    first, end = starts[order], np.maximum.accumulate((starts + sizes)[order] + WINDOW - 1)
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > end[:-1]
    at = np.flatnonzero(new)
    return first[at], end[np.append(at[1:], len(first)) - 1]


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text", 4 * PART):
        data, offsets = text_column(batch, "text")
        data = memoryview(np.ascontiguousarray(data))
        spans = batch.column("spans")
        edges = spans.offsets.to_numpy()
        fields = dict(zip([f.name for f in spans.type.value_type], spans.values.flatten(), strict=True))
        start, size = (np.asarray(fields[n]).astype(np.int64) for n in ("start", "size"))
        removed, runs, digests = [], [], []
        for i in range(len(batch)):
            first, end = covered(start[edges[i] : edges[i + 1]], size[edges[i] : edges[i + 1]])
            digest, a = hashlib.sha256(), int(offsets[i])
            for f, e in zip(first.tolist(), end.tolist(), strict=True):
                digest.update(data[a : int(offsets[i]) + f])
                a = int(offsets[i]) + e
            digest.update(data[a : int(offsets[i + 1])])
            removed.append(int((end - first).sum()))
            runs.append(len(first))
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _named(docs: DataFrame) -> DataFrame:
    """(doc_id, did, dup, text): did orders documents, null last; dup tells texts apart that share an id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    shared = not docs.groupBy("doc_id").count().filter("count > 1").isEmpty()
    dup = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long") if shared else F.lit(0).cast("long")
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), dup.alias("dup"), text.alias("text"))


def _later(rows: DataFrame, *key: str) -> DataFrame:
    """rows with _r, over 1 where a row of the same key starts earlier."""
    return rows.withColumn("_r", F.rank().over(Window.partitionBy(*key).orderBy("did", "dup", "start")))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(did, dup, spans) of the documents that have windows which start earlier: spans of (start, size), in windows. docs: as _named() gives them."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select("did", "dup", "text")
    with shuffles_removed(spark):
        # a stretch comes at most once from each task, so no key here grows with the copies
        found = cut(_later(map_batches(texts, _stretch_rows, STRETCHES), "anchor", "d1", "d2"), "stretches")
        marks = found.filter("mark or _r > 1").select("did", "dup", "start", "size")
        single = found.filter("not mark and _r = 1")
        several = single.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("anchor"), F.ceil(F.col("n") / GROUP).cast("int").alias("shares"))
        wanted = single.join(several, "anchor").select("did", "dup", F.struct("anchor", F.pmod(F.col("d1"), "shares").cast("int").alias("share"), (F.col("shares") > 1).alias("several"), "start", "size").alias("own"))
        wanted = cut(wanted.groupBy("did", "dup").agg(F.collect_list("own").alias("wanted")), "wanted")
        raw = map_batches(texts.hint("merge").join(wanted, ["did", "dup"]), _texts_of, "anchor long, share int, several boolean, did long, dup long, start int, size int, raw binary")
        raw = raw.repartition(tasks, "anchor", "share").sortWithinPartitions("anchor", "share")
        compared = cut(map_batches(raw, _sorter, SPANS), "compared")
        across = _later(compared.filter("d1 is not null"), "d1", "d2").filter("_r > 1")
        spans = marks.unionByName(compared.filter("d1 is null").drop("d1", "d2")).unionByName(across.drop("_r", "d1", "d2"))
        spans = cut(spans.groupBy("did", "dup").agg(F.collect_list(F.struct("start", "size")).alias("spans")), "spans")
    drop(found, wanted, compared)
    return spans


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row: what is left once the bytes of repeated windows are removed.

    A null or empty text has no bytes; texts of fewer than WINDOW bytes lose none. Matches never cross documents. A null
    id is later than all ids. Rows that share an id but not the text are taken in the order of their texts' hashes; rows
    that are repeated whole are one document and all get its result. An empty table gives no rows; other columns are
    ignored.
    """
    spark = docs.sparkSession
    named = _named(docs)
    spans = repeated_spans(named)
    with shuffles_removed(spark):
        joined = named.hint("merge").join(spans, ["did", "dup"], "left")
        joined = joined.select("doc_id", "text", F.coalesce("spans", F.array().cast("array<struct<start:int,size:int>>")).alias("spans"))
        result = cut(map_batches(joined, _kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"), "without_repeats")
    drop(spans)
    return result
