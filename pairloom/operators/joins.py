"""Joins that keys, duplicates and suffixes make easy to get wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_suffixes(left: DataFrame, right: DataFrame, key: str, left_suffix: str = "", right_suffix: str = "_pred", how: str = "inner") -> DataFrame:
    """Equi-join on a string key; columns of both sides get the suffixes. Keys that repeat fan out."""
    shared = (set(left.columns) & set(right.columns)) - {key}
    a = left.select(F.col(key).cast("string").alias(key), *[F.col(f"`{c}`").alias(c + left_suffix if c in shared else c) for c in left.columns if c != key])
    b = right.select(F.col(key).cast("string").alias(key), *[F.col(f"`{c}`").alias(c + right_suffix if c in shared else c) for c in right.columns if c != key])
    return a.join(b, key, how)


def looked_up(df: DataFrame, table: DataFrame, key: str, value: str, into: str, default: object = None, order: str | None = None) -> DataFrame:
    """``df`` with a value by key; of repeated keys the last by ``order`` counts, without one the greatest value."""
    once = table.groupBy(key).agg((F.max_by(value, order) if order else F.max(value)).alias("__v"))
    joined = df.join(once, key, "left")
    return joined.withColumn(into, F.coalesce("__v", F.lit(default)) if default is not None else F.col("__v")).drop("__v")


def flagged(df: DataFrame, keys: DataFrame, key: str, into: str) -> DataFrame:
    """``df`` with whether its key is in a table."""
    once = keys.select(key).distinct().withColumn("__in", F.lit(True))
    return df.join(once, key, "left").withColumn(into, F.coalesce("__in", F.lit(False))).drop("__in")


def only_in(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in a table."""
    return df.join(keys.select(key), key, "left_semi")


def not_in(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in a table: what is left to do."""
    return df.join(keys.select(key), key, "left_anti")
