"""Merkle manifest of a dataset by sibling-shift self-joins (operator 13).

Every row is a leaf. The leaves of a language, in the order of their ids, form a tree, and the trees' roots, in the order
of the languages, form the tree of the dataset. At every level the nodes meet their siblings in an equi-join: a node's
siblings have computed places, `place XOR 1` in a binary tree and `first place of the run + (slot + k) mod arity`
otherwise. After it the rows in slot zero emit the parents. No key of these joins repeats, so a language that has most
rows is spread like any other. Going down again, a node's path is its own siblings followed by its parent's path, so every
level is joined once with the half as large level above.

Places are given by range partitions of the whole table and their sizes; no task or window sees a language's rows.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from lectern.operators.search import ranked

from .common import cut, drop, shuffles_removed

ARITY = 2
#: Levels that one plan goes down.
STEPS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows whose unsigned crc32 of the decimal id is divisible by this are tampered with.
TAMPER_STEP = 7


def part(value: Column) -> Column:
    """`-` for null, else UTF-8 bytes, a colon, the value; so no two different rows give one text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: dict[str, Column]) -> Column:
    """SHA-256 in hex of a row's fields in their fixed order."""
    return F.sha2(F.concat(*[part(fields[name]) for name in FIELDS]), 256)


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _numbered(leaves: DataFrame) -> tuple[DataFrame, list[DataFrame], Row]:
    """(leaves as nodes, the tables that they are read from, number of trees and leaves of the largest). A node has tree, place from 0, n (nodes of its tree at its level) and hash."""
    spark = leaves.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["lang", "doc_id", "leaf"]
    dealt = leaves.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # written once, as another evaluation may draw other bounds between the partitions
    dealt = cut(dealt.withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()}), "leaves")
    runs = dealt.groupBy("_p", "lang").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    langs = cut(ranked(runs.groupBy("lang").agg(F.sum("_n").alias("n")), [F.col("lang")], "tree"), "trees")
    # a row for each partition and each language in it
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("lang").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("_p", F.col("lang").alias("_lang"), (F.col("_first") - before).alias("_shift"))
    runs = runs.join(langs.withColumnRenamed("lang", "_of"), F.col("_lang").eqNullSafe(F.col("_of"))).drop("_of").withColumnRenamed("_p", "_q")
    placed = dealt.join(runs, (F.col("_p") == F.col("_q")) & F.col("lang").eqNullSafe(F.col("_lang")))
    nodes = placed.select("tree", (F.col("_m") - F.col("_shift")).alias("place"), "n", F.unhex("leaf").alias("hash"), "doc_id", "leaf", "tampered")
    size = langs.agg(F.count("*").alias("trees"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    return nodes, [dealt, langs], size


def _with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """nodes and `before` and `after`: the digests of a run's other nodes to the left and to the right, one after another."""
    slot, own = F.col("place") % arity, nodes
    for k in range(1, arity):
        shifted = F.col("place").bitwiseXOR(F.lit(1).cast("long")) if arity == 2 else F.col("place") - slot + (slot + k) % arity
        others = nodes.select(F.col("tree").alias("_tree"), F.col("place").alias("_place"), F.col("hash").alias(f"_h{k}"))
        own = own.join(others, (F.col("tree") == F.col("_tree")) & (shifted == F.col("_place")), "left").drop("_tree", "_place")
    none = F.lit(b"")
    at = lambda s, j: F.coalesce(F.col(f"_h{(j - s) % arity}"), none)
    sides = [F.when(slot == s, F.struct(F.concat(none, *[at(s, j) for j in range(s)]).alias("before"), F.concat(none, *[at(s, j) for j in range(s + 1, arity)]).alias("after"))) for s in range(arity)]
    return own.withColumn("_side", F.coalesce(*sides)).withColumns({"before": F.col("_side.before"), "after": F.col("_side.after")}).drop("_side", *[f"_h{k}" for k in range(1, arity)])


def _levels(nodes: DataFrame, most: int, arity: int) -> list[DataFrame]:
    """The written levels of all trees, leaves first; a tree's last node stands in its own level alone. most: leaves of the largest tree."""
    levels = []
    while True:
        with shuffles_removed(nodes.sparkSession):
            levels.append(cut(_with_siblings(nodes, arity), "level"))
        if most <= 1:
            return levels
        most = -(-most // arity)
        parents = levels[-1].filter((F.col("n") > 1) & (F.col("place") % arity == 0))
        hashed = F.unhex(F.sha2(F.concat(_hex(F.col("hash")), _hex(F.col("after"))), 256))
        nodes = parents.select("tree", F.expr(f"place div {arity}").alias("place"), F.ceil(F.col("n") / arity).alias("n"), hashed.alias("hash"))


def _tops(levels: list[DataFrame]) -> DataFrame:
    """(tree, hash) of the trees' roots."""
    tops = None
    for level in levels:
        own = level.filter("n = 1").select("tree", "hash")
        tops = own if tops is None else tops.unionAll(own)
    return tops


def _paths(levels: list[DataFrame], tops: DataFrame, arity: int, carried: list[str], made: list[DataFrame]) -> DataFrame:
    """The nodes of the first level with `path` (before and after of every level up to the root) and the columns that their tree's row in `tops` has.

    Every STEPS levels the paths are written, so that no plan grows with the depth; `made` gets those tables.
    """
    up = None
    for k, level in reversed(list(enumerate(levels))):
        kept = [c for c in level.columns if c not in ("before", "after", "n")] if k == 0 else ["tree", "place"]
        found = level.filter("n = 1").join(tops, "tree").select(*kept, "path", *carried)
        if up is not None:
            above = up.withColumnsRenamed({"tree": "_tree", "place": "_place"})
            inner = level.filter("n > 1").join(above, (F.col("tree") == F.col("_tree")) & (F.expr(f"place div {arity}") == F.col("_place")))
            found = found.unionAll(inner.select(*kept, F.concat(F.array(F.struct("before", "after")), F.col("path")).alias("path"), *carried))
        if k and k % STEPS == 0:
            with shuffles_removed(level.sparkSession):
                found = cut(found, "paths")
            made.append(found)
        up = found
    return up


def merkle_manifest(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    The leaf covers doc_id, source, lang, n_chars and text, null or not; other columns don't count. Null ids come first in
    their language, rows that share an id follow the order of their leaves, and equal rows each have a place of their own.
    A null language is a tree like any other. One row alone is its own subroot and root. An empty table gives no rows.
    """
    spark = docs.sparkSession
    own = {name: F.col(name) for name in FIELDS}
    # one more than the largest long has its own digits, too
    more = own | {"n_chars": F.when(F.crc32(F.col("doc_id").cast("string")) % TAMPER_STEP == 0, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(20,0)"))}
    leaves = cut(docs.select("doc_id", "lang", leaf_of(own).alias("leaf"), leaf_of(more).alias("tampered")), "hashed")
    nodes, sources, size = _numbered(leaves)
    levels = _levels(nodes, size.most, arity)
    subroots = _tops(levels)
    upper = _levels(subroots.select(F.lit(0).cast("long").alias("tree"), (F.col("tree") - 1).alias("place"), F.lit(size.trees).cast("long").alias("n"), "hash"), size.trees, arity)
    no_path = F.array().cast("array<struct<before:binary,after:binary>>")
    start = _tops(upper).select("tree", no_path.alias("path"), F.col("hash").alias("root"))
    made: list[DataFrame] = []
    tops = _paths(upper, start, arity, ["root"], made).select((F.col("place") + 1).alias("tree"), "path", "root", F.col("hash").alias("subroot"))
    tops = cut(tops, "tops")
    found = _paths(levels, tops, arity, ["root", "subroot"], made)
    proof = F.array_join(F.transform("path", lambda x: F.concat(_hex(x["before"]), _hex(x["after"]))), "")
    folded = F.aggregate("path", F.col("tampered"), lambda h, x: F.sha2(F.concat(_hex(x["before"]), h, _hex(x["after"])), 256))
    root = _hex(F.col("root"))
    out = found.select("doc_id", "leaf", _hex(F.col("subroot")).alias("subroot"), root.alias("root"), F.sha2(proof, 256).alias("proof_sha256"), folded.alias("folded_root"))
    with shuffles_removed(spark):
        result = cut(out.withColumn("verified", F.col("folded_root") == F.col("root")), "manifest")
    drop(leaves, *sources, *levels, *upper, tops, *made)
    return result


def _sql_part(x: str) -> str:
    return f"coalesce(strlen({x}::varchar)::varchar || ':' || {x}::varchar, '-')"


def _sql_leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_sql_part(x) for x in ("doc_id", "source", "lang", n_chars, "text")) + ")"


# DuckDB has no crc32: the sum of the table's entries for a number's digits, worked out by the rule of the polynomial.
ORACLE = f"""
with recursive crc_table(i, step, c) as (
  select i, 0, i::ubigint from range(256) t(i)
  union all select i, step + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end from crc_table where step < 8),
crc(doc_id, rest, c) as (
  select distinct doc_id, doc_id::varchar, 4294967295::ubigint from documents where doc_id is not null
  union all
  select crc.doc_id, substr(rest, 2), xor(t.c, crc.c >> 8) from crc join crc_table t on t.step = 8 and t.i = xor(crc.c & 255, ascii(rest)::ubigint) where rest <> ''),
marked as (select doc_id as id, xor(c, 4294967295::ubigint) % {TAMPER_STEP} = 0 as tamper from crc where rest = ''),
hashed as (
  select d.doc_id, lang, {_sql_leaf("n_chars")} as leaf, {_sql_leaf("(n_chars + case when tamper then 1 else 0 end)")} as tampered
  from documents d left join marked m on m.id = d.doc_id),
langs as (select lang, row_number() over (order by lang nulls first) - 1 as tree, count(*) over () as trees from (select distinct lang from documents)),
leaves as (
  select tree, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by tree) as n, doc_id, leaf, tampered
  from hashed h join langs l on h.lang is not distinct from l.lang),
nodes(tree, level, place, n, hash) as (
  select tree, 0, place, n, leaf from leaves
  union all
  select tree, level + 1, place // 2, any_value((n + 1) // 2), sha256(string_agg(hash, '' order by place)) from nodes where n > 1 group by tree, level, place // 2),
subroots as (select tree, hash from nodes where n = 1),
upper(level, place, n, hash) as (
  select 0, tree, (select count(*) from subroots), hash from subroots
  union all
  select level + 1, place // 2, any_value((n + 1) // 2), sha256(string_agg(hash, '' order by place)) from upper where n > 1 group by level, place // 2),
steps as (
  select l.tree, l.place, k.level as step, s.hash as sibling, (l.place >> k.level) % 2 as slot
  from leaves l join (select distinct tree, level from nodes where n > 1) k on k.tree = l.tree
  left join nodes s on s.tree = l.tree and s.level = k.level and s.place = xor(l.place >> k.level, 1)
  union all
  select l.tree, l.place, 1000 + k.level, s.hash, (l.tree >> k.level) % 2
  from leaves l cross join (select distinct level from upper where n > 1) k
  left join upper s on s.level = k.level and s.place = xor(l.tree >> k.level, 1)),
numbered as (select *, row_number() over (partition by tree, place order by step) as k from steps),
proofs as (select tree, place, sha256(coalesce(string_agg(sibling, '' order by k), '')) as proof_sha256, max(k) as last from numbered group by tree, place),
folds(tree, place, k, h) as (
  select tree, place, 0, tampered from leaves
  union all
  select f.tree, f.place, f.k + 1, sha256(case when slot = 1 then coalesce(sibling, '') || h else h || coalesce(sibling, '') end)
  from folds f join numbered s on s.tree = f.tree and s.place = f.place and s.k = f.k + 1)
select l.doc_id, l.leaf, s.hash as subroot, r.hash as root, coalesce(p.proof_sha256, sha256('')) as proof_sha256, f.h as folded_root, f.h = r.hash as verified
from leaves l join subroots s on s.tree = l.tree join (select hash from upper where n = 1) r on true
left join proofs p on p.tree = l.tree and p.place = l.place
join folds f on f.tree = l.tree and f.place = l.place and f.k = coalesce(p.last, 0)
"""
