"""Queries on postal addresses of one location."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.addresses import located, located_pairs, places_of_rows, same_location
from pairloom.session import cut_lineage
from pairloom.sources.tables import table

ALT, BASE = ("id", "addresses"), ("base_id", "base_addresses")


def _places(spark: SparkSession, folder: str) -> DataFrame:
    return located(table(spark, folder, "project_a_samples"), ALT, BASE).places()


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of different places that stand at the same location."""
    return same_location(_places(spark, folder))


def p3_places(spark: SparkSession, folder: str) -> DataFrame:
    """(place, location): the class of every place that has one."""
    return _places(spark, folder)


def _locations(places: DataFrame) -> DataFrame:
    """(location, n_places, first_place): each location with the different places there."""
    return places.groupBy("location").agg(F.count(F.lit(1)).alias("n_places"), F.min("place").alias("first_place"))


def p3_locations(spark: SparkSession, folder: str) -> DataFrame:
    """Each location with the number of different places there; ``p3_places`` has the places themselves."""
    return _locations(_places(spark, folder))


def normalised_locations(df: DataFrame) -> DataFrame:
    """(location, n_places, first_place, n_agreeing) by the normal addresses of both sides.

    ``n_agreeing`` counts the different pairs of which both sides stand at the location.
    """
    found = cut_lineage(located_pairs(df, ("id", "norm_conflated_addr"), ("base_id", "norm_base_addr")))
    agree = found.filter(F.col("a_location") == F.col("b_location")).select("a_id", "b_id", F.col("a_location").alias("location")).distinct()
    agree = agree.groupBy("location").agg(F.count(F.lit(1)).alias("n"))
    return _locations(places_of_rows(found)).join(agree, "location", "left").select("location", "n_places", "first_place", F.coalesce("n", F.lit(0)).alias("n_agreeing"))


def p3_normalised(spark: SparkSession, folder: str) -> DataFrame:
    """Locations of ``norm_conflated_addr`` and ``norm_base_addr`` of phase1_processed, with the places and agreeing pairs there."""
    return normalised_locations(table(spark, folder, "phase1_processed"))


QUERIES = {"p3_found": p3_found, "p3_places": p3_places, "p3_locations": p3_locations, "p3_normalised": p3_normalised}
ORACLES: dict[str, str] = {}
