"""Lookups of keys that very many rows may share, and ladders of aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key that more than one in so many rows have is hot.
HOT_SHARE = 1000


def look_up(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """rows, left-joined with found: a stored table with one row for each key, whose n counts the key's rows.

    Hot keys number less than HOT_SHARE whatever the input, so they are broadcast, and their rows stay in their tasks, as
    do rows without the key. Only the rest is shuffled on the key, of which no key has more than its share.
    """
    total = found.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_SHARE > total
    often = F.broadcast(found.filter(hot))
    stay = rows.join(often, key, "left").filter(F.col(key).isNull() | F.col("n").isNotNull())
    moved = rows.filter(F.col(key).isNotNull()).join(often, key, "left_anti").join(found.filter(~hot), key, "left")
    return stay.unionByName(moved)


def resolve_aliases(rows: DataFrame, code: str, forms: list[Column], aliases: DataFrame) -> DataFrame:
    """(code, n, name) of each distinct code of rows: how many rows have it, and the name of its first form that aliases knows.

    forms are columns over `code`, in the order in which they are tried; null where one doesn't apply. aliases: (alias,
    name); of rows that repeat an alias the least name counts. The forms of distinct codes meet the aliases in one join.
    A code without a known form has a null name; a null code has no row.
    """
    counted = rows.filter(F.col(code).isNotNull()).groupBy(code).agg(F.count("*").alias("n"))
    tried = counted.select(code, "n", F.posexplode(F.array(*forms)).alias("place", "alias")).filter("alias is not null")
    known = aliases.groupBy("alias").agg(F.min("name").alias("name"))
    first = F.min(F.when(F.col("name").isNotNull(), F.struct("place", "name")))
    return tried.join(known, "alias", "left").groupBy(code).agg(F.max("n").alias("n"), first["name"].alias("name"))
