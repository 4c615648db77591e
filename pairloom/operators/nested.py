"""Nested JSON columns as flat child tables that keep the link to pair and parent element."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Path to the innermost elements of each nested column of a place record; [] stands for the elements of an array.
PLACE_PATHS = {
    "sources": ["[]", "lineage", "revisions", "[]", "rev"],
    "names": ["rules", "[]", "perspectives", "countries", "[]"],
    "categories": ["alternate", "[]", "taxonomy", "path", "[]"],
}


def flatten(df: DataFrame, key: str, paths: dict[str, list[str]]) -> DataFrame:
    """(key, field_name, parent_no, child_no, child): the innermost elements at ``paths`` in the JSON columns.

    ``parent_no`` is the position in the outermost array of the path, ``child_no`` that in the innermost. Nulls keep
    their position and give no row, as do NULL and unreadable texts; repeated rows count once.
    """
    for path in paths.values():
        if path.count("[]") != 2:
            raise ValueError("a path has one outer and one inner array")
    columns = list(paths)
    named = {f: [s for s in p if s != "[]"] for f, p in paths.items()}
    # A text without the names on the path (and without escapes that could spell them) has no element there.
    slim = [
        F.when(F.least(*[F.contains(F.col(f), F.lit(s)).cast("int") for s in named[f]], F.lit(1)) == 1, F.col(f))
        .when(F.contains(F.col(f), F.lit("\\u")), F.col(f)).alias(f)
        for f in columns
    ]
    slim_df = df.select(F.col(key).alias("__key"), *slim).filter(F.col("__key").isNotNull() & F.coalesce(*columns).isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pairloom.functions.jsonindex import index, walk

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for i, name in enumerate(columns, 1):
                values = index(batch.column(i).to_pylist())
                found, taken = walk(values, paths[name])
                texts = [values.text(j) for j in found]
                kept = [j for j, text in enumerate(texts) if text is not None]
                docs = values.doc[found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([keys[docs[j]] for j in kept], pa.string()), pa.array([name] * len(kept), pa.string()),
                        pa.array(taken[kept, 0], pa.int32()), pa.array(taken[kept, 1], pa.int32()), pa.array([texts[j] for j in kept], pa.string()),
                    ],
                    ["key", "field_name", "parent_no", "child_no", "child"],
                )

    rows = slim_df.mapInArrow(run, "key string, field_name string, parent_no int, child_no int, child string")
    return rows.withColumnRenamed("key", key).distinct()
