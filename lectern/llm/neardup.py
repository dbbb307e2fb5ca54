"""Near-duplicate groups by HyperMinHash (operator 9).

Words are maximal runs of non-white bytes with A-Z lowered; a document's set is its distinct 5-word shingles (the
whole sequence with fewer words; empty without words). Documents link at Jaccard similarity >= 0.75.

1. One Arrow pass: each document gets a digest of its set and `bands * rows` registers. Register k keeps, of the least
   value of the k-th hash function over the set, the leading-zero count and `MANTISSA` bits after it (two bytes).
2. Equal sets collapse into classes, so groups of exact copies cost one row from then on.
3. Bands of registers form buckets. In each round every member of a bucket is compared with one pivot of its bucket,
   never with all others. Pairs pass a collision-corrected estimate, then an exact check on the full sets.
4. The confirmed links become components. Buckets that then still hold two components or more are compared inside tasks
   by signatures of more registers, block against block. First each document's nearest one of another component is
   verified; a last round verifies all pairs across components that may link, so no link is lost to the choice of pivots.
   A document that no other one came near to in the first of these rounds has no such pair, so the last round leaves it out.

Probability that a pair at similarity exactly 0.75 shares no band: (1 - 0.75^4)^32 = 5e-6; it falls fast above.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, look_up, map_batches, mix, sliced, words

SHINGLE = 5
BANDS, ROWS = 32, 4
MANTISSA = 10
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: The estimate may be below the threshold by so many standard deviations before a pair is dropped unverified.
SLACK_SD = 5
#: Registers, four bits of each, that documents get which share a bucket with another component.
SIGNATURE, SIGNATURE_SLACK_SD = 1024, 4
#: Rounds that compare each document of a bucket with its nearest one of another component, before the round that compares all.
NEAREST_ROUNDS = 1
#: Larger buckets are dealt into blocks of about so many documents; each task compares two blocks.
BLOCK = 1024
#: So many ids at most (24 MB as a hash table) are broadcast to pick documents; above that, documents are shuffled.
BROADCAST_IDS = 1_000_000

_SEEDS = mix(np.arange(1, 2 * 1024 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's distinct shingles, ascending within the row, and each row's first position, with the total at the end."""
    hashes, first = words(batch, name)
    n_words = np.diff(first)
    n = np.where(n_words >= SHINGLE, n_words - SHINGLE + 1, (n_words > 0).astype(np.int64))
    factors = mix(np.arange(11, 11 + SHINGLE, dtype=np.uint64)) | np.uint64(1)
    total = np.zeros(len(hashes), dtype=np.uint64)
    for k in range(SHINGLE):
        if len(hashes) > k:
            total[: len(hashes) - k] += hashes[k:] * factors[k]
    row = np.repeat(np.arange(len(n)), n)
    begins = np.concatenate([[0], np.cumsum(n)])
    place = first[:-1][row] + np.arange(begins[-1]) - begins[:-1][row]
    out = total[place]
    for i in np.flatnonzero((n_words > 0) & (n_words < SHINGLE)):
        own = hashes[first[i] : first[i + 1]]
        out[begins[i]] = np.sum(own * factors[: len(own)], dtype=np.uint64) + np.uint64(len(own))
    out = mix(out)
    parts = [np.unique(out[a:b]) for a, b in zip(begins[:-1], begins[1:], strict=True)]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    return (np.concatenate(parts) if parts else out), np.concatenate([[0], np.cumsum(sizes)])


def registers(sets: np.ndarray, first: np.ndarray, count: int = BANDS * ROWS) -> np.ndarray:
    """Compressed registers, one row for each non-empty set: leading zeros << MANTISSA | mantissa bits of each least hash."""
    starts = first[:-1][np.diff(first) > 0]
    out = np.empty((len(starts), count), dtype=np.uint16)
    if not len(starts):
        return out
    moved = np.empty_like(sets)
    for k in range(count):
        np.bitwise_xor(sets, _SEEDS[2 * k], out=moved)
        np.multiply(moved, _SEEDS[2 * k + 1] | np.uint64(1), out=moved)
        least = np.minimum.reduceat(moved, starts)
        part, exponent = np.frexp(least.astype(np.float64))
        zeros = np.clip(64 - exponent, 0, 63).astype(np.uint16)
        bits = np.minimum(((part - 0.5) * (2 << MANTISSA)).astype(np.int64), (1 << MANTISSA) - 1).clip(0)
        out[:, k] = (zeros << np.uint16(MANTISSA)) | bits.astype(np.uint16)
    return out


def chance_equal(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Expected share of registers that agree by chance between two unrelated sets of n and m shingles."""
    octave = np.arange(64)
    low, high = 2.0 ** -(octave + 1.0), 2.0 ** -(octave * 1.0)
    inside = lambda x: np.exp(-np.outer(x, low)) - np.exp(-np.outer(x, high))
    return (inside(n) * inside(m)).sum(1) / (1 << MANTISSA)


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, corrected for chance collisions."""
    c = chance_equal(n, m)
    return (equal - c) / (1 - c)


def _sketch(batches):
    for batch in sliced(batches, "text"):
        sets, first = shingle_sets(batch)
        n = np.diff(first)
        have = n > 0
        regs = registers(sets, first)
        sums = np.zeros((len(n), 2), dtype=np.uint64)
        if have.any():
            starts = first[:-1][have]
            sums[have, 0] = np.add.reduceat(sets, starts)
            sums[have, 1] = np.add.reduceat(mix(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
        digest = sums.tobytes()
        size = regs.shape[1] * 2
        raw, at, out = regs.tobytes(), 0, []
        for h in have:
            out.append(raw[at : at + size] if h else None)
            at += size * bool(h)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n), pa.array([digest[16 * i : 16 * i + 16] if h else None for i, h in enumerate(have)], pa.binary()), pa.array(out, pa.binary())],
            names=["doc_id", "n_shingles", "digest", "regs"],
        )


def _close(batches):
    """Of pairs with registers, those whose corrected estimate leaves room for a link."""
    floor = PERCENT / 100
    floor -= SLACK_SD * (floor * (1 - floor) / (BANDS * ROWS)) ** 0.5
    for b in batches:
        if not b.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint16).reshape(b.num_rows, -1) for c in ("regs_a", "regs_b"))
        n, m = (np.asarray(b.column(c)).astype(float) for c in ("n_a", "n_b"))
        keep = estimate((x == y).mean(1), n, m) >= floor
        keep &= 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)
        yield b.select(["a", "b"]).filter(pa.array(keep))


def _signatures(batches):
    """The low four bits of SIGNATURE registers, by which far pairs can be told."""
    for batch in sliced(batches, "text"):
        sets, first = shingle_sets(batch)
        n = np.diff(first)
        low = registers(sets, first, SIGNATURE).astype(np.uint8) & 15
        packed = low[:, ::2] | low[:, 1::2] << 4
        kept = pa.array(n > 0)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").filter(kept), pa.array([p.tobytes() for p in packed], pa.binary())], names=["doc_id", "sig"])


def _compare(every: bool):
    """Compares members of a bucket, or of two blocks of one, across components.

    It yields pairs that may link and share no earlier band: all of them, or each document's nearest one.
    """
    share = (1 - PERCENT / 100) * 15 / 16
    most = SIGNATURE * share + SIGNATURE_SLACK_SD * (SIGNATURE * share * (1 - share)) ** 0.5
    nibbles = np.uint64(0x1111111111111111)

    def run(table: pa.Table) -> pa.Table:
        n = table.num_rows
        ids, component, size, block = (np.asarray(table.column(c)) for c in ("doc_id", "component", "n_shingles", "block"))
        band, i, j = (table.column(c)[0].as_py() for c in ("band", "i", "j"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint64).reshape(n, -1)
        regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint64).reshape(n, BANDS, -1)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found = [np.zeros((0, 2), np.int64)]
        for at in range(0, len(left), 32):
            own = left[at : at + 32]
            z = sig[own][:, None, :] ^ sig[right][None, :, :]
            z |= z >> np.uint64(1)
            z |= z >> np.uint64(2)
            unlike = np.bitwise_count(z & nibbles).sum(2, dtype=np.int64)
            n_a, n_b = size[own][:, None], size[right][None, :]
            fits = (unlike <= most) & (component[own][:, None] != component[right][None, :]) & (100 * np.minimum(n_a, n_b) >= PERCENT * np.maximum(n_a, n_b))
            if not every:
                unlike[~fits] = SIGNATURE + 1
                nearest = np.zeros_like(fits)
                nearest[np.arange(len(own)), unlike.argmin(1)] = True
                if i != j:
                    nearest[unlike.argmin(0), np.arange(len(right))] = True
                fits &= nearest
            x, y = np.nonzero(fits)
            x, y = own[x], right[y]
            new = ~(regs[x, :band] == regs[y, :band]).all(2).any(1) if every else np.ones(len(x), bool)
            found.append(np.stack([np.minimum(ids[x], ids[y])[new], np.maximum(ids[x], ids[y])[new]], 1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def _sets(batches):
    for batch in sliced(batches, "text"):
        sets, first = shingle_sets(batch)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([sets[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], names=["doc_id", "shingles"])


def _confirmed(batches):
    for b in batches:
        keep = []
        for x, y in zip(b.column("set_a"), b.column("set_b"), strict=True):
            s, t = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = len(np.intersect1d(s, t, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(s) + len(t) - both))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b), by least labels with pointer jumping: (id, component), component the least id reachable.

    Each round is a join on ids and a grouped minimum; its table is written to the shared folder. It ends when no label moves.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    label = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(label.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = label.join(near, "id").select("id", F.least("component", "near").alias("component"))
        jump = step.alias("s").join(label.select(F.col("id").alias("to"), F.col("component").alias("further")), F.col("component") == F.col("to"), "left")
        new = cut(jump.select("id", F.least("component", "further").alias("component")), "labels")
        moved = new.join(label.select("id", F.col("component").alias("old")), "id").filter("component <> old").isEmpty()
        drop(label)
        label = new
        if moved:
            drop(both)
            return label


def _band_keys() -> Column:
    width = 2 * ROWS
    return F.posexplode(F.array(*[F.xxhash64(F.lit(k), F.substring("regs", 1 + k * width, width)) for k in range(BANDS)]))


class NearDuplicates:
    """The stages, each a table in the shared folder. docs needs doc_id and text; other columns are ignored."""

    def __init__(self, docs: DataFrame):
        self.docs = docs.select("doc_id", "text")
        self.made: list[DataFrame] = []

    def _cut(self, df: DataFrame, name: str) -> DataFrame:
        """A table that is deleted once the result is written."""
        self.made.append(cut(df, name))
        return self.made[-1]

    def _of(self, ids: DataFrame) -> DataFrame:
        """The documents with these distinct ids; they are broadcast if that is proven to be small."""
        ids = self._cut(ids, "ids")
        return self.docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")

    def _estimated(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose estimate by the banded registers leaves room for a link."""
        side = lambda s: self.classes.select(F.col("doc_id").alias(s), F.col("regs").alias(f"regs_{s}"), F.col("n_shingles").alias(f"n_{s}"))
        return map_batches(pairs.join(side("a"), "a").join(side("b"), "b"), _close, "a long, b long")

    def _verify(self, close: DataFrame) -> DataFrame:
        """Links among close pairs (a, b), on full sets, which are made only for the documents of these pairs."""
        close = cut(close, "close")
        ids = close.select(F.col("a").alias("doc_id")).union(close.select("b")).distinct()
        sets = cut(map_batches(self._of(ids), _sets, "doc_id long, shingles binary"), "sets")
        side = lambda s: sets.select(F.col("doc_id").alias(s), F.col("shingles").alias(f"set_{s}"))
        links = self._cut(map_batches(close.join(side("a"), "a").join(side("b"), "b"), _confirmed, "a long, b long"), "links")
        drop(sets)
        drop(close)
        return links

    def run(self) -> DataFrame:
        """(doc_id, n_shingles, component_id, kept), one row for each input row."""
        sketch = self._cut(map_batches(self.docs, _sketch, "doc_id long, n_shingles long, digest binary, regs binary"), "sketch")
        self.classes = self._cut(
            # in a struct null comes first, so a flag puts null ids last
            sketch.filter("digest is not null")
            .groupBy("digest")
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "n_shingles", "regs")).alias("c"), F.count("*").alias("n"))
            .select("digest", "c.doc_id", "c.n_shingles", "c.regs", "n"),
            "classes",
        )
        bands = self.classes.select("doc_id", _band_keys()).select(F.col("pos").alias("band"), F.col("col").alias("key"), "doc_id")
        shared = bands.groupBy("band", "key").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last")).filter("pivot < last")
        members = self._cut(bands.join(shared, ["band", "key"]).select("band", "key", "doc_id", "pivot"), "members")
        links = self._verify(self._estimated(members.filter("doc_id <> pivot").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).distinct()))
        members = members.select("band", "key", "doc_id")
        label = components(links)
        spark, marks = self.docs.sparkSession, None
        tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        for every in (*[False] * NEAREST_ROUNDS, True):
            placed = members.join(label.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
            split = placed.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).filter("lo < hi")
            blocks = F.ceil(F.col("n") / BLOCK).cast("int")
            apart = cut(placed.join(split.select("band", "key", blocks.alias("blocks")), ["band", "key"]), "apart")
            if apart.isEmpty():
                break
            if marks is None:
                ids = apart.select("doc_id").distinct()
                marks = map_batches(self._of(ids), _signatures, "doc_id long, sig binary").join(self.classes.select("doc_id", "n_shingles", "regs"), "doc_id")
                marks = self._cut(marks, "marks")
            block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
            dealt = apart.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            dealt = dealt.join(marks, "doc_id").withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
            # comparing costs more than the rows' bytes tell, so the number of tasks is stated
            pairs = dealt.drop("blocks", "other").repartition(tasks, "band", "key", "i", "j").groupBy("band", "key", "i", "j").applyInArrow(_compare(every), "a long, b long")
            pairs = self._cut(pairs.distinct(), "pairs")
            new = self._verify(pairs)
            drop(apart)
            near = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
            members = members.join(near, "doc_id", "left_semi")
            if not new.isEmpty():
                links = self._cut(links.union(new), "links")
                drop(label)
                label = components(links)
        self.made.append(label)
        label = label.select(F.col("id").alias("class_id"), "component")
        place = self.classes.select("digest", "n", F.col("doc_id").alias("class_id")).join(label, "class_id", "left")
        place = self._cut(place.select("digest", "n", F.coalesce("component", "class_id").alias("component_id")), "place")
        out = look_up(sketch.select("doc_id", "n_shingles", "digest"), place, "digest")
        own = F.coalesce("component_id", "doc_id")
        result = cut(out.select("doc_id", "n_shingles", own.alias("component_id"), (F.col("doc_id") == own).alias("kept")), "groups")
        drop(*self.made)
        return result


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Near-duplicate group of every document.

    Nulls: null or blank text has an empty set, is linked with nothing and kept; a null doc_id is passed through with
    kept null and takes no part in links unless it is its class's only id. Very long texts are read whole. Repeated
    rows fall into one class and each gets its row; rows that share an id count as one document. An empty table gives an
    empty result.
    """
    return NearDuplicates(docs).run()


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that are kept: of each group the document with the least id.

    Of rows that repeat an id one stays. Only the ids that go are joined with docs, broadcast if they are proven to be few.
    """
    found = near_duplicates(docs)

    def ids(df: DataFrame) -> DataFrame:
        df = cut(df.select("doc_id").distinct(), "ids")
        return F.broadcast(df) if df.count() <= BROADCAST_IDS else df

    kept = docs.join(ids(found.filter("not kept")), "doc_id", "left_anti")
    twice = ids(found.filter("kept").groupBy("doc_id").count().filter("count > 1"))
    if not twice.isEmpty():
        kept = kept.join(twice, "doc_id", "left_anti").unionByName(kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return kept.select(docs.columns)
