"""Entries of JSON array columns as rows, with their place in the array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.jsonx import as_objects
from pairloom.functions.timestamps import CANONICAL, with_instants


def exploded(df: DataFrame, key: str, column: str, fields: str, keep: Column | None = None) -> DataFrame:
    """(key, entry_no, the named fields) of each entry of ``column``; unreadable JSON has no entries."""
    names = [f.split(":")[0].strip() for f in fields.split(",")]
    if keep is not None:
        df = df.filter(keep)
    rows = df.select(F.col(key).alias("place_id"), F.posexplode(as_objects(F.col(column), fields)).alias("entry_no", "entry"))
    return rows.select("place_id", "entry_no", *[F.col(f"entry.{n}").alias(n) for n in names])


def source_instants(df: DataFrame, feeds: DataFrame, sides: dict[str, str], keep_canonical: bool = True) -> DataFrame:
    """(place_id, entry_no, epoch_us) of every ``sources`` entry that denotes an instant.

    ``sides`` maps the column of each side's place id to its column of sources. Repeated rows count once; NULL ids,
    NULL or unreadable sources and entries without a readable time give no row.
    """
    fields = "dataset:string,update_time:string"
    parts = [exploded(df, key, column, fields, F.col(key).isNotNull() & F.col(column).isNotNull()) for key, column in sides.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = rows.filter(F.col("update_time").isNotNull())
    if not keep_canonical:
        rows = rows.filter(~F.regexp_like("update_time", F.lit(CANONICAL)))
    timed = with_instants(rows, "update_time", "dataset", feeds, drop_missing=True)
    return timed.select("place_id", "entry_no", "epoch_us").distinct()
