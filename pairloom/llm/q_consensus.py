"""Queries on the consensus of winner labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.consensus import decide, fit, gathered, reliabilities, winner
from pairloom.session import cut_lineage
from pairloom.sources.tables import table

ATTRIBUTES = ("name", "phone", "web", "address", "category")
ITEM = ["id", "attr"]


def opinions(spark: SparkSession, folder: str) -> DataFrame:
    """(id, attr, annotator, label, at) of all three tables; the golden, _slm and _truth winners are one annotator each."""
    hands = table(spark, folder, "winner_labels").select("id", F.lower(F.trim("attr")).alias("attr"), F.col("annotator_id").alias("annotator"), winner(F.col("winner")).alias("label"), F.col("labelled_at").cast("timestamp").alias("at"))

    def wide(name: str, suffix: str, annotator: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(a).alias("attr"), F.col(f"attr_{a}_winner{suffix}").cast("string").alias("w")) for a in ATTRIBUTES])
        rows = table(spark, folder, name).select("id", F.explode(pairs).alias("p"))
        return rows.select("id", "p.attr", F.lit(annotator).alias("annotator"), winner(F.col("p.w")).alias("label"), F.lit(None).cast("timestamp").alias("at"))

    golden = wide("golden_dataset_200", "", "(golden)")
    checks = [wide("incorrect_predictions", f"_{s}", f"({s})") for s in ("slm", "truth")]
    return hands.unionByName(golden).unionByName(checks[0]).unionByName(checks[1])


def _consensus(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, object]:
    items = cut_lineage(gathered(opinions(spark, folder), ITEM))
    model = fit(items)
    return items, decide(items, ITEM, model), model


def p1_consensus(spark: SparkSession, folder: str) -> DataFrame:
    """Winner, posterior, difficulty and chance-corrected agreement of every item with an opinion."""
    return _consensus(spark, folder)[1]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The winner of each item of winner_labels with opinions from at least three annotators."""
    found = p1_consensus(spark, folder).filter(F.col("n_annotators") >= 3)
    asked = table(spark, folder, "winner_labels").select("id", F.lower(F.trim("attr")).alias("attr")).distinct()
    return found.join(asked, ITEM, "left_semi").select("id", "attr", "winner")


def p1_annotators(spark: SparkSession, folder: str) -> DataFrame:
    """Reliability of every annotator."""
    items, found, model = _consensus(spark, folder)
    return reliabilities(items, found, ITEM, model)


QUERIES = {"p1_found": p1_found, "p1_consensus": p1_consensus, "p1_annotators": p1_annotators}
ORACLES: dict[str, str] = {}
