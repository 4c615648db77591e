"""Readers, writers, reports, memos and orchestration."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.text import cache_key
from pairloom.operators.profile import columns_with
from pairloom.schemas import require_columns
from pairloom.session import bounded_rows


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, expected: list[str] | None = None) -> DataFrame:
    """A parquet table with some of its columns; ``ValueError`` if an expected one is missing."""
    df = spark.read.parquet(path)
    if expected:
        require_columns(df, expected, path)
    return df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV table with a header line; without a schema all columns are strings."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrite a parquet table."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_parquet(df: DataFrame, path: str) -> None:
    """Add rows to a parquet table; nothing written before is written again."""
    df.write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file of a small table."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def query_file(spark: SparkSession, path: str, sql: str) -> DataFrame:
    """SQL over a file; the text says {table} where the file goes."""
    return spark.sql(sql.replace("{table}", f"parquet.`{path}`"))


def markdown(df: DataFrame, title: str, rows: int = 200) -> str:
    """A small table as markdown."""
    found = bounded_rows(df, rows, title)
    cell = lambda v: f"{v:.4f}" if isinstance(v, float) else "" if v is None else str(v)
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(v) for v in r) + " |" for r in found), ""])


def write_report(path: str, sections: dict[str, DataFrame]) -> None:
    """A markdown report of small tables."""
    with open(path, "w", encoding="utf-8") as file:
        file.write("\n".join(markdown(df, title) for title, df in sections.items()))


def memoised(df: DataFrame, kind: str, column: str, cache: DataFrame | None, check: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(``df`` with valid and reason, rows to add to the cache): each distinct value is checked at most once.

    ``cache`` has key, valid, reason; ``check`` takes distinct values (value) and gives (value, valid, reason).
    Empty values are invalid and are not cached.
    """
    values = df.select(F.col(column).alias("value")).filter(F.coalesce("value", F.lit("")) != "").distinct().withColumn("key", cache_key(F.lit(kind), F.col("value")))
    known = values.join(cache.select("key", "valid", "reason"), "key") if cache is not None else None
    todo = values.join(cache.select("key"), "key", "left_anti") if cache is not None else values
    fresh = check(todo.select("value")).withColumn("key", cache_key(F.lit(kind), F.col("value")))
    answers = fresh.select("value", "valid", "reason")
    answers = answers.unionByName(known.select("value", "valid", "reason")) if known is not None else answers
    joined = df.join(answers.withColumnRenamed("value", column), column, "left")
    empty = F.coalesce(F.col(column), F.lit("")) == ""
    out = joined.withColumns({"valid": F.when(empty, False).otherwise(F.col("valid")), "reason": F.when(empty, "Empty value").otherwise(F.col("reason"))})
    return out, fresh.select("key", "valid", "reason")


def files_with(spark: SparkSession, folder: str, literal: str = "match") -> DataFrame:
    """(file, column, n): string columns of parquet and CSV files in a folder that hold a literal."""
    found = spark.createDataFrame([], "file string, column string, n long")
    for name in sorted(os.listdir(folder)):
        path = os.path.join(folder, name)
        if name.endswith((".parquet", ".csv")):
            df = spark.read.parquet(path) if name.endswith(".parquet") else read_csv(spark, path)
            found = found.unionByName(columns_with(df, literal).withColumn("file", F.lit(name)))
    return found


def settings_from(path: str) -> dict[str, str]:
    """KEY=VALUE lines of a file, comments and blank lines passed over; the environment has the last word."""
    out = {}
    with open(path, encoding="utf-8") as file:
        for line in file:
            text = line.strip()
            if text and not text.startswith("#") and "=" in text:
                key, _, value = text.partition("=")
                out[key.strip()] = value.strip().strip("\"'")
    return {k: os.environ.get(k, v) for k, v in out.items()}


def run_all(tasks: list[tuple[str, str, Callable[[], None]]], depends_on: str, force: bool = False) -> dict[str, str]:
    """Run (name, output path, task) in order; one whose output is newer than ``depends_on`` is skipped unless forced."""
    told = {}
    for name, output, task in tasks:
        fresh = os.path.exists(output) and os.path.getmtime(output) >= os.path.getmtime(depends_on)
        if fresh and not force:
            told[name] = "skipped"
            continue
        try:
            task()
            told[name] = "done"
        except Exception as error:  # one failing task leaves the others
            told[name] = f"failed: {error}"
    return told
