"""Exact top-k search over binary codes by incremental multi-index hashing (operator 2).

A code has a bit for each dimension, in words of 64 bits, and is cut into pieces of about as many bits as the number of
codes has: then a value of a piece is shared by a few codes only, however large the table. If two codes differ in at most r bits, some piece differs in at most
floor(r / pieces). So with all pieces searched up to radius s, every code within pieces * (s + 1) - 1 bits is found.
The radius grows round by round, for the queries alone whose k-th verified neighbour is not yet within that bound.

Equal codes are one entry with its least ids, so a code shared by a third of all rows costs one probe. The codes of a
piece's value lie together in blocks of bounded size, and a probe meets a block, not its codes one by one.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop

BITS = 64
#: Pieces of a word at most, as shorter ones tell little apart, and at least, as balls of longer ones are too large.
MOST_PIECES, LEAST_PIECES = 5, 2
K = 10
#: Every row whose id is divisible by this is a query.
QUERY_STEP = 20
#: Codes of a block, about.
BLOCK = 256


def pieces_of(words: int, codes: int) -> list[tuple[int, int, int]]:
    """(word, first bit, bits) of each piece: of log2(codes) bits or a little less, by the rule of multi-index hashing."""
    n = min(MOST_PIECES, max(LEAST_PIECES, math.ceil(BITS / max(1.0, math.log2(max(2, codes))))))
    return [(w, BITS * i // n, BITS * (i + 1) // n - BITS * i // n) for w in range(words) for i in range(n)]


def code_of(embedding: Column, words: int = 1) -> Column:
    """Sign bits of all dimensions in an array of words, first dimension highest in each; null elements count as not positive.

    With fewer than 64 dimensions a word ends with the last one.
    """
    word = lambda k: F.aggregate(F.slice(embedding, 1 + BITS * k, BITS), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")))
    return F.array(*[word(k) for k in range(words)])


def _distance(one: Column, other: Column, words: int) -> Column:
    return sum((F.bit_count(one[k].bitwiseXOR(other[k])) for k in range(1, words)), F.bit_count(one[0].bitwiseXOR(other[0])))


def _piece(code: Column, piece: tuple[int, int, int]) -> Column:
    word, first, size = piece
    return F.shiftrightunsigned(code[word], first).bitwiseAND(F.lit((1 << size) - 1)).cast("int")


def _ball(size: int, radius: int) -> list[int]:
    """All words of `size` bits with at most `radius` ones."""
    return [sum(1 << b for b in bits) for r in range(min(radius, size) + 1) for bits in combinations(range(size), r)]


def _least(df: DataFrame, key: str, order: list, k: int) -> DataFrame:
    """The first k rows of each key; Spark cuts each task's share to k rows a key before it shuffles."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_r") <= k).drop("_r")


def _postings(classes: DataFrame, pieces: list[tuple[int, int, int]]) -> DataFrame:
    """(piece, value, entries): blocks of codes that share a piece's value, each code with its least id."""
    rows = classes.select("code", "least", F.explode(F.array(*[F.struct(F.lit(i).alias("piece"), _piece(F.col("code"), p).alias("value")) for i, p in enumerate(pieces)])).alias("p")).select("code", "least", "p.*")
    blocks = rows.groupBy("piece", "value").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    # Spark takes exploded rows to be as few as their source, so joins of them must be kept from broadcasting them
    salted = rows.hint("merge").join(blocks, ["piece", "value"]).withColumn("block", F.pmod(F.xxhash64("code"), F.col("blocks")))
    return salted.groupBy("piece", "value", "block").agg(F.collect_list(F.struct("least", "code")).alias("entries")).drop("block")


def search(vectors: DataFrame, k: int = K, step: int = QUERY_STEP) -> DataFrame:
    """(query_id, rank, vec_id, distance): the k nearest other rows of each query row, by Hamming distance, then id.

    Queries are the rows whose id is divisible by `step`. Rows without an id or an embedding are neither searched nor found;
    all dimensions count, and shorter embeddings have shorter codes. A query finds fewer than k rows
    where there are no more. Rows that repeat an id count once, with the least of their codes. Other columns are ignored.
    """
    longest = vectors.agg(F.max(F.size("embedding")).alias("n")).first().n or 0
    words = max(1, -(-longest // BITS))
    bits = words * BITS
    coded = vectors.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long"), code_of(F.col("embedding"), words).alias("code"))
    made = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        made.append(cut(df, name))
        return made[-1]

    coded = kept(coded.groupBy("vec_id").agg(F.min("code").alias("code")), "codes")
    near = _least(coded, "code", [F.col("vec_id")], k + 1)
    classes = kept(near.groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("least", F.col("ids")[0]), "classes")
    pieces = pieces_of(words, classes.count())
    postings = kept(_postings(classes, pieces), "postings")
    queries = coded.filter(F.col("vec_id") % step == 0)
    pending = kept(queries.select(F.col("code").alias("query")).distinct(), "pending")
    found, radius = None, 0
    if coded.limit(k + 1).count() <= k:  # every row is in every answer: the widest search at once
        radius = max(size for _, _, size in pieces) - 1
    while not pending.isEmpty():
        bound = len(pieces) * (radius + 1) - 1
        probes = None
        for i, piece in enumerate(pieces):
            # one literal, which Spark folds to a constant array
            ball = F.explode(F.split(F.lit(",".join(map(str, _ball(piece[2], radius)))), ",").cast("array<int>")).alias("flip")
            own = pending.select("query", _piece(F.col("query"), piece).alias("own"), ball)
            own = own.select("query", F.lit(i).alias("piece"), F.col("own").bitwiseXOR(F.col("flip")).alias("value"))
            probes = own if probes is None else probes.unionAll(own)
        measured = F.transform("entries", lambda e: F.struct(_distance(e["code"], F.col("query"), words).alias("distance"), e["least"].alias("least"), e["code"].alias("code")))
        best = F.slice(F.array_sort(F.filter(measured, lambda e: e["distance"] <= bound)), 1, k + 1)
        hits = probes.hint("merge").join(postings, ["piece", "value"]).select("query", best.alias("best")).filter(F.size("best") > 0)
        hits = hits.select("query", F.explode("best").alias("hit")).select("query", "hit.*").distinct()
        top = _least(hits, "query", [F.col("distance"), F.col("least")], k + 1).join(classes.select("code", "ids"), "code")
        top = kept(top.select("query", "distance", "ids"), "top")
        done = top.groupBy("query").agg(F.sum(F.size("ids")).alias("n")).filter(F.lit(bound >= bits) | (F.col("n") > k)).select("query")
        found = top.join(done, "query", "left_semi") if found is None else found.unionAll(top.join(done, "query", "left_semi"))
        pending = kept(pending.join(done, "query", "left_anti"), "pending") if bound < bits else pending.limit(0)
        radius += 1
    if found is None:
        found = classes.select(F.col("code").alias("query"), F.lit(0).alias("distance"), "ids").limit(0)
    each = _least(found.select("query", "distance", F.explode("ids").alias("vec_id")), "query", [F.col("distance"), F.col("vec_id")], k + 1)
    pairs = queries.select(F.col("vec_id").alias("query_id"), F.col("code").alias("query")).join(each, "query").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    result = cut(pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("distance").cast("int").alias("distance")), "nearest")
    drop(*made)
    return result


ORACLE = f"""
with p as (select a.vec_id as query_id, b.vec_id,
                  list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: case when (z[1] > 0) <> (z[2] > 0) then 1 else 0 end))::int as distance
           from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % {QUERY_STEP} = 0),
     r as (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from p)
select query_id, rank::int as rank, vec_id, distance from r where rank <= {K}
"""
