"""Queries on token budgets: containers and mixes of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.mixing import mix
from pairloom.llm.packing import bucket_only, histograms, pack
from pairloom.llm.tokens import with_token_counts
from pairloom.session import bounded_rows, cut_lineage
from pairloom.sources.tables import table


def _sized(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", *columns, "text")
    return with_token_counts(docs, "text").drop("text")


def _capacities(spark: SparkSession, folder: str) -> dict[str, int]:
    rows = bounded_rows(table(spark, folder, "pack_sizes").filter("capacity_tokens > 0 AND pack_name IS NOT NULL"), 1_000, "pack_sizes")
    return {r.pack_name: int(r.capacity_tokens) for r in rows}


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every document, by pack; a document longer than the capacity has several parts."""
    return pack(_sized(spark, folder), "doc_id", "n_tokens", _capacities(spark, folder))


def p8_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Containers, tokens and share of space used by pack, beside the share if batches never left their bucket."""
    sized = cut_lineage(_sized(spark, folder))
    capacities = _capacities(spark, folder)
    alone = [(name, capacities[name], bucket_only(*shape, capacities[name])) for name, shape in histograms(sized, "doc_id", "n_tokens", capacities).items()]
    rows = pack(sized, "doc_id", "n_tokens", capacities).groupBy("pack_name", "container_no").agg(F.sum("n_tokens").alias("t"))
    used = rows.groupBy("pack_name").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("t").alias("n_tokens"), F.max("t").alias("fullest"))
    told = spark.createDataFrame(alone, "pack_name string, capacity long, alone long")
    share = F.col("n_tokens") / (F.col("n_containers") * F.col("capacity"))
    return used.join(told, "pack_name").select("pack_name", "capacity", "n_containers", "n_tokens", "fullest", share.alias("used"), (F.col("n_tokens") / (F.col("alone") * F.col("capacity"))).alias("used_in_buckets"))


def _mixed(spark: SparkSession, folder: str, fill: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    domain = F.when(F.col("verified_visit"), "verified").when(~F.col("verified_visit"), "unverified").otherwise("unknown")
    records = _sized(spark, folder, "source", "lang", "verified_visit").withColumn("domain", domain)
    return mix(records, table(spark, folder, "mix_targets"), fill=fill)


def p9_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """How often each document is used."""
    return _mixed(spark, folder)[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of every source."""
    return _mixed(spark, folder)[1]


def p9_short(spark: SparkSession, folder: str) -> DataFrame:
    """Budgets of all leaves for a mix of half as many tokens again as there are: what leaves lack goes to siblings first."""
    return _mixed(spark, folder, fill=1.5)[2]


QUERIES = {"p8_containers": p8_containers, "p8_usage": p8_usage, "p9_repeats": p9_repeats, "p9_shares": p9_shares, "p9_short": p9_short}
ORACLES: dict[str, str] = {}
