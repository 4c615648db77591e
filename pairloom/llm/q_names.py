"""Queries on text that looks the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.skeleton import alike_pairs, look_alike_groups, main_name
from pairloom.sources.tables import table


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs whose main names differ in characters but look the same."""
    pairs = table(spark, folder, "project_a_samples").filter(F.col("id").isNotNull())
    return alike_pairs(pairs, "id", main_name(F.col("names")), main_name(F.col("base_names"))).select("id").distinct()


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Main names of both sides by skeleton, where one skeleton is written in several ways."""
    pairs = table(spark, folder, "project_a_samples")
    both = pairs.select(main_name(F.col("names")).alias("name")).unionByName(pairs.select(main_name(F.col("base_names")).alias("name")))
    return look_alike_groups(both, "name")


QUERIES = {"p5_found": p5_found, "p5_groups": p5_groups}
ORACLES: dict[str, str] = {}
