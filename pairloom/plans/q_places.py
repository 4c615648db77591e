"""Queries on the nested and timed columns of place pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.entries import source_instants
from pairloom.operators.nested import PLACE_PATHS, flatten
from pairloom.sources.tables import table

SIDES = {"id": "sources", "base_id": "base_sources"}


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Instants of the entries not yet written in the one unambiguous form."""
    return source_instants(table(spark, folder, "project_a_samples"), table(spark, folder, "feed_zones"), SIDES, keep_canonical=False)


def p4_instants(spark: SparkSession, folder: str) -> DataFrame:
    """One UTC instant for each entry that has one, however it was written."""
    found = source_instants(table(spark, folder, "project_a_samples"), table(spark, folder, "feed_zones"), SIDES)
    # a timestamp without zone, so that the session's own zone has no part in it
    at = F.expr("cast(timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(epoch_us AS decimal(18, 0)) / 1000000) AS string)")
    return found.withColumn("instant", F.concat(F.replace(at, F.lit(" "), F.lit("T")), F.lit("Z")))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Innermost elements of sources, names and categories, tied to parent element and pair."""
    return flatten(table(spark, folder, "project_a_samples"), "id", PLACE_PATHS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p4_found": p4_found, "p4_instants": p4_instants, "p6_found": p6_found}

_OPENED = """
  opened AS (
    SELECT DISTINCT id, field_name,
      CASE WHEN json_valid(raw) AND json_type(raw) = 'VARCHAR' THEN json_extract_string(raw, '$') ELSE raw END AS txt
    FROM (SELECT id, 'sources' AS field_name, sources AS raw FROM project_a_samples
          UNION ALL SELECT id, 'names', names FROM project_a_samples
          UNION ALL SELECT id, 'categories', categories FROM project_a_samples)),
  doc AS (SELECT id, field_name, CAST(txt AS JSON) AS j FROM opened WHERE json_valid(txt)),
  outer_list AS (
    SELECT id, field_name, CASE field_name WHEN 'sources' THEN j WHEN 'names' THEN json_extract(j, '$.rules') ELSE json_extract(j, '$.alternate') END AS o FROM doc),
  outer_rows AS (
    SELECT id, field_name, CASE WHEN json_type(o) = 'ARRAY' THEN CAST(o AS JSON[]) WHEN o IS NULL OR json_type(o) = 'NULL' THEN [] ELSE [o] END AS items FROM outer_list),
  parents AS (
    SELECT id, field_name, unnest(items) AS e, unnest(range(len(items))) AS parent_no FROM outer_rows),
  inner_list AS (
    SELECT id, field_name, parent_no, CASE field_name WHEN 'sources' THEN json_extract(e, '$.lineage.revisions') WHEN 'names' THEN json_extract(e, '$.perspectives.countries') ELSE json_extract(e, '$.taxonomy.path') END AS n FROM parents),
  inner_rows AS (
    SELECT id, field_name, parent_no, CASE WHEN json_type(n) = 'ARRAY' THEN CAST(n AS JSON[]) WHEN n IS NULL OR json_type(n) = 'NULL' THEN [] ELSE [n] END AS items FROM inner_list),
  leaves AS (
    SELECT id, field_name, parent_no, unnest(items) AS c, unnest(range(len(items))) AS child_no FROM inner_rows)
"""

ORACLES: dict[str, str] = {
    "p6_found": f"""
WITH {_OPENED}
SELECT DISTINCT id, field_name, CAST(parent_no AS INTEGER) AS parent_no, CAST(child_no AS INTEGER) AS child_no, child
FROM (SELECT id, field_name, parent_no, child_no, CASE WHEN field_name = 'sources' THEN json_extract_string(c, '$.rev') ELSE json_extract_string(c, '$') END AS child FROM leaves)
WHERE child IS NOT NULL AND id IS NOT NULL
""",
}
