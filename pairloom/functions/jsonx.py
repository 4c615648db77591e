"""JSON text held in string columns, read with JVM-side expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unwrap_json(c: Column) -> Column:
    """JSON text that was itself written as a JSON string, one level deep, becomes the inner text.

    NULL stays NULL; text that starts with a quote and is no JSON string becomes NULL.
    """
    quoted = F.regexp_like(c, F.lit(r'^\s*"'))
    return F.when(quoted, F.get_json_object(F.concat(F.lit("["), c, F.lit("]")), "$[0]")).otherwise(c)


def as_objects(c: Column, fields: str) -> Column:
    """Array of structs from JSON text; a lone object is an array of one, anything unreadable is NULL."""
    return F.from_json(unwrap_json(c), f"array<struct<{fields}>>")


def as_object(c: Column, fields: str) -> Column:
    """Struct from JSON text; unreadable text gives a struct of NULLs or NULL."""
    return F.from_json(unwrap_json(c), f"struct<{fields}>")
