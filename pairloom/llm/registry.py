"""Queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairloom.plans.catalog import gather

MODULES = ("q_names", "q_addresses", "q_overlap", "q_consensus", "q_fusion", "q_tokens", "q_pii")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return gather("pairloom.llm", MODULES)[0]


def oracles() -> dict[str, str]:
    return gather("pairloom.llm", MODULES)[1]
