"""Data quality checks; each returns a row for every violation (Q)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Rejected(ValueError):
    """A snapshot that must not be published."""


def schema_problems(actual: T.StructType, declared: T.StructType) -> list[tuple[str, str]]:
    """(column, problem): missing, unexpected, type or nullability (Q1)."""
    have, want = ({f.name: f for f in s.fields} for s in (actual, declared))
    rows = [(c, "missing") for c in want if c not in have] + [(c, "unexpected") for c in have if c not in want]
    for c in want.keys() & have.keys():
        if have[c].dataType != want[c].dataType:
            rows.append((c, "type"))
        elif have[c].nullable and not want[c].nullable:
            rows.append((c, "nullability"))
    return sorted(rows)


def schema_differences(spark: SparkSession, actual: T.StructType, declared: T.StructType) -> DataFrame:
    return spark.createDataFrame(schema_problems(actual, declared), "column string, problem string")


def dangling(child: DataFrame, key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """(relation, key): distinct foreign keys that the parent doesn't have."""
    own = child.select(F.col(key).cast("string").alias("key")).filter("key is not null").distinct()
    return own.join(parent.select(F.col(parent_key).cast("string").alias("key")).distinct(), "key", "left_anti").select(F.lit(name).alias("relation"), "key")


def foreign_keys(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def singleton(df: DataFrame, key: str, required: list[str]) -> DataFrame:
    """One row: whether df is exactly one row with id 1 and no blank required field (Q4)."""
    blank = reduce(lambda a, b: a | b, [F.coalesce(F.trim(c), F.lit("")) == "" for c in required])
    return df.agg(F.count("*").alias("n"), F.min(key).alias("least"), F.max(key).alias("most"), F.count_if(blank).alias("blank")).withColumn("ok", F.expr("coalesce(n = 1 and least = 1 and most = 1 and blank = 0, false)"))


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(rule, key) for each row and each rule that it breaks; a rule that is null counts as kept (Q5, Q8)."""
    broken = F.array_compact(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()]))
    return df.select(F.explode(broken).alias("rule"), F.col(key).cast("string").alias("key"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once, with their number (Q6, Q7, Q9)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def disagreement(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Groups whose rows don't agree in all columns (Q11)."""
    return df.groupBy(group).agg(F.count_distinct(F.struct(*columns)).alias("states")).filter("states > 1")


def strict(df: DataFrame, mode: str, what: str) -> DataFrame:
    """failfast: raises if df has a row; permissive: returns df (Q10)."""
    if mode not in ("failfast", "permissive"):
        raise ValueError(f"unknown mode {mode}")
    if mode == "failfast" and not df.isEmpty():
        raise Rejected(what)
    return df
