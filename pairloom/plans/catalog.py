"""All registered queries of the core and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("q_places", "q_labels", "q_text", "q_tables", "q_checks")


def gather(package: str, modules: tuple[str, ...]) -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """QUERIES and ORACLES of the named modules, merged."""
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    oracles: dict[str, str] = {}
    for name in modules:
        module = importlib.import_module(f"{package}.{name}")
        queries |= module.QUERIES
        oracles |= module.ORACLES
    return queries, oracles


def core() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    return gather("pairloom.plans", MODULES)
