"""Session-wide helpers: the shared checkpoint folder, size-checked broadcasts and bounded collects."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Settings a new session starts with; a cluster's own session keeps its own.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and single machines."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("pairloom")
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions)} | conf
    return builder.config(map=settings).getOrCreate()


def use_shared_checkpoints(spark: SparkSession) -> str:
    """Point checkpoints at the cluster's shared folder.

    The folder is read from ``spark.checkpoint.dir``. Only where that is unset and the session runs in one process
    (tests) a temporary folder is made and recorded in the session; on a cluster a missing folder raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="pairloom-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", folder)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there; survives the loss of executors."""
    use_shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_rows(df: DataFrame, limit: int, what: str) -> list[Row]:
    """Collect a table that has to be small; more than ``limit`` rows raise instead of flooding the driver."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows, the bound of what is sent to the driver; raise the bound if its memory allows")
    return rows


#: Largest table that is broadcast, in bytes of its values.
MAX_BROADCAST_BYTES = 32 * 2**20


def _row_bytes(df: DataFrame) -> Column:
    sizes = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 16 for c in df.columns]
    return sum(sizes[1:], sizes[0])


def broadcast_within(df: DataFrame, limit: int, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only after measuring that ``df`` has at most ``limit`` rows and ``max_bytes`` bytes.

    Otherwise the join is left to shuffle.
    """
    first = df.limit(limit + 1).select(_row_bytes(df).alias("bytes"))
    rows, size = first.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    return F.broadcast(df) if rows <= limit and size <= max_bytes else df


def large_parts(df: DataFrame, part: str, limit: int, max_bytes: int = MAX_BROADCAST_BYTES, max_parts: int = 1_000) -> set[int]:
    """The values of the column ``part`` whose rows are too many or too large to broadcast, by the measure of ``broadcast_within``.

    All parts are measured in one pass over ``df``, which has to be computed already.
    """
    sizes = df.select(part, _row_bytes(df.drop(part)).alias("bytes")).groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    return {r[part] for r in bounded_rows(sizes, max_parts, "parts to measure") if r["n"] > limit or r["bytes"] > max_bytes}
