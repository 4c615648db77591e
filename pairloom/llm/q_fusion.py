"""Queries on the best representative of duplicate places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.fusion import FIELDS, claims, duplicates, learn_sources, survivors
from pairloom.session import cut_lineage
from pairloom.sources.tables import table


def _duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return cut_lineage(duplicates(table(spark, folder, "project_a_samples"), table(spark, folder, "feed_zones"), table(spark, folder, "golden_dataset_200")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The survivors by posterior that the exact check finds undisputed; it only drops rows."""
    return survivors(_duplicates(spark, folder)).filter("is_undisputed").select("base_id", "field_name", "id")


def p2_survivors(spark: SparkSession, folder: str) -> DataFrame:
    """One surviving record per group: each field's text, the alt it is from and its posterior."""
    chosen = survivors(_duplicates(spark, folder))
    texts = table(spark, folder, "project_a_samples").select("base_id", "id", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in FIELDS])).alias("f"))
    texts = texts.select("base_id", "id", "f.field_name", "f.text").groupBy("base_id", "id", "field_name").agg(F.max("text").alias("text"))
    full = chosen.join(texts, ["base_id", "id", "field_name"])
    cells = [F.max(F.when(F.col("field_name") == f, F.col(c))).alias(f"{f}_{c}" if c != "text" else f) for f in FIELDS for c in ("text", "id", "posterior")]
    return full.groupBy("base_id").agg(*cells)


def p2_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy of every source and its likeliest partner in copying."""
    model = learn_sources(cut_lineage(claims(_duplicates(spark, folder))))
    rows = []
    for s, a in sorted(model.accuracy.items()):
        near = [(p, x if y == s else y) for (x, y), p in model.depends.items() if s in (x, y)]
        rows.append((s, a, max(near)[1] if near else None, max(near)[0] if near else None))
    return spark.createDataFrame(rows, "source string, accuracy double, partner string, dependence double")


QUERIES = {"p2_found": p2_found, "p2_survivors": p2_survivors, "p2_sources": p2_sources}
ORACLES: dict[str, str] = {}
