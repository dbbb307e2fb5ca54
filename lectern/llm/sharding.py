"""Sharding by extendible hashing (operator 1), in DataFrame operations only.

A directory is indexed by the leading bits of a key's hash. A bucket is a prefix of those bits with its rows' bytes; a
bucket over the limit splits on the next bit, the others stay, until every shard fits or holds one key only. All prefixes'
bytes come from one histogram of long prefixes, which is combined before it is shuffled; its size follows the number of
shards, not of rows. Buckets still too large at that length are looked at down to whole hashes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Bits of a hash.
BITS = 60
#: Bytes that a shard may hold.
SHARD_BYTES = 1 << 20
#: Bits of the histogram's prefixes beyond those that evenly filled shards need.
SPARE_BITS = 4


def hash_of(key: Column) -> Column:
    """The first BITS bits of the md5 of a key as text; a null key counts as ''."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _leaves(histogram: DataFrame, low: int, high: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """(leaves, too_large) among the prefixes of low to high bits; histogram: (prefix of high bits, bytes, docs, first, last).

    leaves: (depth, prefix, shard_bytes, shard_docs); too_large: the prefixes of high bits that must split further.
    """
    depth = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")
    nodes = histogram.select(depth, "prefix", "bytes", "docs", "first", "last").withColumn("prefix", F.expr(f"shiftright(prefix, {high} - depth)"))
    nodes = nodes.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"), F.min("first").alias("first"), F.max("last").alias("last"))
    nodes = cut(nodes.withColumn("fits", (F.col("bytes") <= limit) | (F.col("first") == F.col("last"))), "nodes")
    # a bucket exists if the one it splits from didn't fit; at `low` there is none above in this range
    split = nodes.filter("not fits").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"))
    fits = nodes.filter("fits")
    made = fits.filter(F.col("depth") > low).withColumn("above", F.shiftright("prefix", 1)).join(split, ["depth", "above"], "left_semi").drop("above")
    leaves = fits.filter(F.col("depth") == low).unionByName(made).select("depth", "prefix", F.col("bytes").alias("shard_bytes"), F.col("docs").alias("shard_docs"))
    return leaves, nodes.filter(f"depth = {high} and not fits").select("prefix")


def _histogram(keyed: DataFrame, bits: int) -> DataFrame:
    prefix = F.shiftright("hash", BITS - bits).alias("prefix")
    return keyed.groupBy(prefix).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs"), F.min("hash").alias("first"), F.max("hash").alias("last"))


def _directory(leaves: DataFrame, bits: int) -> DataFrame:
    """The directory: a row for each prefix of `bits` bits, with the leaf it belongs to."""
    first = F.expr(f"shiftleft(prefix, {bits} - depth)")
    last = F.expr(f"shiftleft(prefix + 1, {bits} - depth) - 1")
    return leaves.select(F.explode(F.sequence(first, last)).alias("slot"), "depth", "prefix", "shard_bytes", "shard_docs")


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_bytes, depth, prefix, shard_bytes, shard_docs) of every row: its shard is its hash's first `depth` bits, `prefix`.

    A null text has 0 bytes; null keys share one key. Rows that repeat a key stay together; so does a text over the limit:
    such a shard holds one key and may be over the limit. An empty table gives no rows. Other columns are ignored.
    """
    keyed = cut(docs.select(F.col(key).alias("doc_id"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("bytes"), hash_of(F.col(key)).alias("hash")), "keyed")
    total = keyed.agg(F.sum("bytes").alias("n")).first().n or 0
    bits = min(BITS, max(1, math.ceil(math.log2(max(2, total / limit))) + SPARE_BITS))
    leaves, rest = _leaves(_histogram(keyed, bits), 0, bits, limit)
    slots = cut(_directory(leaves, bits), "directory")
    at = keyed.withColumn("slot", F.shiftright("hash", BITS - bits))
    placed = at.join(slots, "slot").drop("slot")
    if bits < BITS and not rest.isEmpty():
        # few rows: buckets of some SPARE_BITS more bits than an even filling needs are still too large
        deep = cut(at.join(rest, F.col("slot") == F.col("prefix"), "left_semi").drop("slot"), "deep")
        leaves, _ = _leaves(_histogram(deep, BITS), bits + 1, BITS, limit)
        leaves = cut(leaves, "leaves")
        depths = [r.depth for r in leaves.select("depth").distinct().collect()]  # at most BITS rows
        for depth in depths:
            own = deep.withColumn("prefix", F.shiftright("hash", BITS - depth))
            placed = placed.unionByName(own.join(leaves.filter(F.col("depth") == depth), "prefix"))
    return placed.select("doc_id", F.col("bytes").alias("n_bytes"), "depth", "prefix", "shard_bytes", "shard_docs")


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES) -> None:
    """Writes docs as Parquet under path, a folder for each shard (depth, prefix), rows in the order of their hashes.

    Rows that repeat a key are all written, to their key's shard. The shuffle is on the shard, so each shard is one file.
    docs may have any columns: they are written as one struct, `row`, so that they don't meet the names of the shards.
    """
    placed = shard(docs, key, text, limit).select("doc_id", "depth", "prefix").distinct()
    own = docs.select(F.col(key).alias("doc_id"), F.struct("*").alias("row"))
    own = own.join(placed, own.doc_id.eqNullSafe(placed.doc_id)).select("depth", "prefix", hash_of(own.doc_id).alias("hash"), "row")
    own.repartition("depth", "prefix").sortWithinPartitions("depth", "prefix", "hash").drop("hash").write.partitionBy("depth", "prefix").parquet(path)


ORACLE = f"""
with k as (select doc_id, strlen(coalesce(text, ''))::bigint as n_bytes,
                  ('0x' || md5(coalesce(cast(doc_id as varchar), ''))[1:{BITS // 4}])::bigint as h from documents),
     n as (select d.depth, h >> ({BITS} - d.depth)::int as prefix, sum(n_bytes)::bigint as shard_bytes, count(*) as shard_docs,
                  sum(n_bytes) <= {SHARD_BYTES} or min(h) = max(h) as fits
           from k, (select unnest(range(0, {BITS + 1})) as depth) d group by 1, 2),
     f as (select k.doc_id, k.n_bytes, n.*, row_number() over (partition by k.h, k.doc_id order by n.depth) as r
           from n join k on k.h >> ({BITS} - n.depth)::int = n.prefix where n.fits)
select doc_id, n_bytes, depth::int as depth, prefix::bigint as prefix, shard_bytes, shard_docs from f where r = 1
"""
