"""Stages, vocabularies and checks of the pair tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Attributes of a pair and the classes of labels.
ATTRIBUTES = ("name", "phone", "web", "address", "category")
DECISIVE_FOR_NONE = ("name", "address", "web")
THREE_CLASSES = ("alt", "both", "base")
FOUR_CLASSES = ("none", "alt", "base", "both")
REFINER_CLASSES = ("alt", "base", "both")
TRUTH_WINNERS = ("base", "alt", "both", "real", "no_data")
GOLDEN_LABELS = ("base", "alt", "abstain")

#: Columns each stage has to have.
STAGES = {
    "raw": ("id", "sources", "names", "categories", "confidence", "websites", "socials", "emails", "phones", "brand", "addresses", "base_id"),
    "phase1": (
        "id", "confidence", "base_confidence", "norm_conflated_addr", "norm_base_addr", "addr_similarity_ratio",
        "norm_conflated_phone", "norm_base_phone", "phone_similarity", "norm_conflated_website", "norm_base_website", "website_similarity",
    ),
    "features": (
        "confidence", "base_confidence", "norm_conflated_addr", "norm_base_addr", "addr_similarity_ratio", "norm_conflated_phone", "norm_base_phone",
        "phone_similarity", "norm_conflated_website", "norm_base_website", "website_similarity", "names", "base_names", "categories", "base_categories", "sources", "base_sources",
    ),
    "phase3": tuple(f"attr_{a}_winner" for a in ATTRIBUTES),
    "golden": ("id", "3class_testlabels"),
}


def missing_columns(df: DataFrame, wanted: tuple[str, ...] | list[str]) -> list[str]:
    """The wanted columns that ``df`` lacks, in order."""
    return [c for c in wanted if c not in df.columns]


def require_columns(df: DataFrame, wanted: tuple[str, ...] | list[str], stage: str) -> DataFrame:
    """``df`` itself; ``ValueError`` if a column is missing."""
    if lacking := missing_columns(df, wanted):
        raise ValueError(f"CRITICAL: {stage} lacks the columns {lacking}")
    return df


def domain_offenders(df: DataFrame, domains: dict[str, tuple[str, ...]]) -> DataFrame:
    """(column, value, n): values outside a column's domain, without case and space, NULLs ignored; one pass."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.lower(F.trim(F.col(c).cast("string"))).alias("value"), F.array(*[F.lit(v) for v in allowed]).alias("allowed")) for c, allowed in domains.items()])
    rows = df.select(F.explode(cells).alias("cell")).select("cell.*")
    return rows.filter(F.col("value").isNotNull() & ~F.array_contains("allowed", F.col("value"))).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def validate(df: DataFrame, stage: str, domains: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``df`` itself; ``ValueError`` for missing columns or values outside their domains."""
    require_columns(df, STAGES[stage], stage)
    if domains:
        bad = domain_offenders(df, domains).orderBy("column", "value").limit(20).collect()
        if bad:
            raise ValueError(f"CRITICAL: {stage} has values out of domain: {[(r['column'], r['value']) for r in bad]}")
    return df


def aligned(df: DataFrame, like: DataFrame) -> DataFrame:
    """``df`` with the columns of ``like`` that it lacks added as NULL, and in the order of ``like`` first."""
    types = dict(like.dtypes)
    extra = [c for c in df.columns if c not in types]
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast(types[c]).alias(c) for c in like.columns], *[F.col(f"`{c}`") for c in extra])


def ensured(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """``df`` with the named columns added where missing."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def without_transient(df: DataFrame) -> DataFrame:
    """``df`` without columns whose names start with an underscore."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith("_")])
