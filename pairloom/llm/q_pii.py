"""Queries on personal information in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairloom.llm.pii import find_pii, redact
from pairloom.sources.tables import table


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every occurrence of personal information in the text of documents."""
    return find_pii(table(spark, folder, "documents"), "doc_id", "text").select("doc_id", "pii_type", "start_pos")


def p10_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """The documents' text with typed placeholders."""
    return redact(table(spark, folder, "documents").select("doc_id", "text"), "text").select("doc_id", "redacted")


QUERIES = {"p10_found": p10_found, "p10_redacted": p10_redacted}
ORACLES: dict[str, str] = {}
