"""Pairs scored as they arrive: the batch transformations on a stream, and a single record."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pairloom.operators.features import engineer_features, prepare_pairs
from pairloom.operators.models import predict
from pairloom.schemas import REFINER_CLASSES

RAW_SCHEMA = ", ".join(f"{p}{c} {'double' if c == 'confidence' else 'string'}" for p in ("", "base_") for c in ("id", "sources", "names", "categories", "confidence", "websites", "socials", "emails", "phones", "brand", "addresses"))


def scored(df: DataFrame, model: PipelineModel, features: list[str], as_of: str, classes: tuple[str, ...] = REFINER_CLASSES) -> DataFrame:
    """Raw pairs with features and predictions; stateless, so it serves tables and streams alike."""
    return predict(model, engineer_features(prepare_pairs(df), as_of), features, classes, "pair")


def score_stream(spark: SparkSession, source: str, target: str, checkpoint: str, model: PipelineModel, features: list[str], as_of: str) -> StreamingQuery:
    """Score parquet files as they are dropped into ``source`` and append them to ``target``, each once."""
    stream = spark.readStream.schema(RAW_SCHEMA).parquet(source)
    return write_stream(stream, lambda df: scored(df, model, features, as_of), target, checkpoint)


def write_stream(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Transform each micro-batch and write it under its batch number, so that a batch run again replaces itself."""
    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class RecordScorer:
    """Predictions for single records."""

    def __init__(self, spark: SparkSession, model: PipelineModel, features: list[str], as_of: str, classes: tuple[str, ...] = REFINER_CLASSES) -> None:
        self.spark, self.model, self.features, self.as_of, self.classes = spark, model, features, as_of, classes

    def predict(self, record: dict) -> dict:
        """Class and probabilities of one raw pair; missing optional fields are NULL, missing required ones an error."""
        for c in ("id", "names", "categories", "sources", "confidence"):
            for p in ("", "base_"):
                if f"{p}{c}" not in record:
                    raise KeyError(f"{p}{c}")
        names = [f.split()[0] for f in RAW_SCHEMA.split(", ")]
        df = self.spark.createDataFrame([tuple(record.get(c) for c in names)], RAW_SCHEMA)
        row = scored(df, self.model, self.features, self.as_of, self.classes).first()
        return {"prediction": row["pair_pred"], "probabilities": {c: row[f"pair_proba_{c}"] for c in self.classes}}
