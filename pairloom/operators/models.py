"""Classifiers over feature frames: MLlib pipelines, nearest neighbours, ensembles and scoring."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.labels import label_2class, label_3class, label_4class
from pairloom.operators.sampling import stratified_folds
from pairloom.schemas import ATTRIBUTES, FOUR_CLASSES
from pairloom.session import cut_lineage, use_shared_checkpoints


def numeric(df: DataFrame, features: list[str]) -> DataFrame:
    """``df`` with missing, NULL and NaN features 0."""
    there = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in features if c in df.columns}
    return df.withColumns(there | {c: F.lit(0.0) for c in features if c not in df.columns})


def _pipeline(features: list[str], classifier: object, scale: bool) -> Pipeline:
    stages: list[object] = [VectorAssembler(inputCols=features, outputCol="_raw")]
    stages.append(StandardScaler(inputCol="_raw", outputCol="_features", withMean=True) if scale else VectorAssembler(inputCols=["_raw"], outputCol="_features"))
    return Pipeline(stages=[*stages, classifier])


def logistic(l2: float = 0.01, weight: str | None = None) -> LogisticRegression:
    """L2 logistic regression."""
    made = LogisticRegression(featuresCol="_features", labelCol="_label", regParam=l2, maxIter=100, probabilityCol="_proba", predictionCol="_pred", rawPredictionCol="_score")
    return made.setWeightCol(weight) if weight else made


def boosted(depth: int = 1, rounds: int = 50, rate: float = 0.1, subsample: float = 0.8, seed: int = 42) -> GBTClassifier:
    """Boosted trees; stumps at depth 1."""
    made = GBTClassifier(featuresCol="_features", labelCol="_label", predictionCol="_pred", maxDepth=depth, maxIter=rounds, stepSize=rate, subsamplingRate=subsample, seed=seed)
    return made.setProbabilityCol("_proba").setRawPredictionCol("_score")


def forest(trees: int = 100, depth: int = 8, weight: str | None = None, seed: int = 42) -> RandomForestClassifier:
    """Random forest."""
    made = RandomForestClassifier(featuresCol="_features", labelCol="_label", numTrees=trees, maxDepth=depth, seed=seed, probabilityCol="_proba", predictionCol="_pred", rawPredictionCol="_score")
    return made.setWeightCol(weight) if weight else made


def stump() -> DecisionTreeClassifier:
    """One split."""
    return DecisionTreeClassifier(featuresCol="_features", labelCol="_label", maxDepth=1, probabilityCol="_proba", predictionCol="_pred", rawPredictionCol="_score")


def one_vs_rest(rounds: int = 30, depth: int = 3, rate: float = 0.1, subsample: float = 1.0, seed: int = 42) -> OneVsRest:
    """Boosted trees for several classes."""
    inner = GBTClassifier(featuresCol="_features", labelCol="_label", predictionCol="_pred", maxDepth=depth, maxIter=rounds, stepSize=rate, subsamplingRate=subsample, seed=seed).setRawPredictionCol("_score")
    return OneVsRest(classifier=inner, featuresCol="_features", labelCol="_label", predictionCol="_pred", rawPredictionCol="_score")


def balanced(rows: DataFrame, classes: tuple[str, ...], cap: float | None = None) -> dict[str, float]:
    """Weight of each class that makes all weigh the same in ``rows`` (column _label), at most ``cap``."""
    counts = {classes[int(r["_label"])]: r["n"] for r in rows.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    made = {c: sum(counts.values()) / (len(counts) * n) for c, n in counts.items()}
    return {c: min(w, cap) if cap else w for c, w in made.items()}


def fit(df: DataFrame, features: list[str], label: Column, classes: tuple[str, ...], classifier: object, scale: bool = False, weights: dict[str, float] | str | None = None, cap: float | None = None) -> PipelineModel:
    """Train on the rows whose label is one of ``classes``; ``weights`` by class, or "balanced" with at most ``cap``."""
    index = F.lit(None).cast("double")
    for i, c in enumerate(classes):
        index = F.when(label == c, float(i)).otherwise(index)
    rows = numeric(df, features).withColumn("_label", index).filter(F.col("_label").isNotNull())
    if weights is not None:
        told = balanced(rows, classes, cap) if weights == "balanced" else weights
        weight = F.lit(1.0)
        for i, c in enumerate(classes):
            weight = F.when(F.col("_label") == i, F.lit(float(told.get(c, 1.0)))).otherwise(weight)
        rows, classifier = rows.withColumn("_weight", weight), classifier.copy().setWeightCol("_weight")
    use_shared_checkpoints(df.sparkSession)  # boosting cuts its lineage there
    return _pipeline(features, classifier, scale).fit(rows)


def predict(model: PipelineModel, df: DataFrame, features: list[str], classes: tuple[str, ...], prefix: str) -> DataFrame:
    """``df`` with {prefix}_pred and, where the classifier has probabilities, {prefix}_proba_{class}; first of equals wins."""
    scored = model.transform(numeric(df, features))
    names = F.array(*[F.lit(c) for c in classes])
    if "_proba" not in scored.columns:
        return scored.withColumn(f"{prefix}_pred", F.get(names, F.col("_pred").cast("int"))).drop("_raw", "_features", "_score", "_pred")
    p = vector_to_array("_proba")
    best = F.array_position(p, F.array_max(p)).cast("int") - 1
    cells = {f"{prefix}_proba_{c}": F.coalesce(F.get(p, F.lit(i)), F.lit(0.0)) for i, c in enumerate(classes)}
    return scored.withColumns(cells | {f"{prefix}_pred": F.get(names, best)}).drop("_raw", "_features", "_score", "_pred", "_proba")


def fit_per_attribute(df: DataFrame, features: list[str], classifier: Callable[[], object] = forest) -> dict[str, PipelineModel]:
    """One model per attribute winner."""
    return {a: fit(df, features, F.lower(F.trim(f"attr_{a}_winner")), FOUR_CLASSES, classifier()) for a in ATTRIBUTES}


def predict_per_attribute(models: dict[str, PipelineModel], df: DataFrame, features: list[str], suffix: str = "_model") -> DataFrame:
    """``df`` with attr_{a}_winner{suffix} of all attributes and the record labels that follow."""
    for a, model in models.items():
        df = predict(model, df, features, FOUR_CLASSES, f"attr_{a}").withColumnRenamed(f"attr_{a}_pred", f"attr_{a}_winner{suffix}")
    return aggregate_attributes(df, suffix)


def aggregate_attributes(df: DataFrame, suffix: str) -> DataFrame:
    """``df`` with 4-, 3- and 2-class labels from per-attribute predictions."""
    return df.withColumns({f"label_4class{suffix}": label_4class(suffix), f"label_3class{suffix}": label_3class(suffix), f"label_2class{suffix}": label_2class(suffix)})


def blend(first: Column, second: Column, weight: float | Column = 0.8) -> Column:
    """Weighted mean of two probabilities."""
    return first * weight + second * (1 - weight)


def sigmoid(c: Column, most: float = 30.0) -> Column:
    """1 / (1 + e^-x), x kept within ``most`` of 0."""
    return 1 / (1 + F.exp(-F.greatest(F.least(c, F.lit(most)), F.lit(-most))))


def log_odds(c: Column, least: float = 1e-6) -> Column:
    """log(p / (1 - p)), p kept ``least`` off 0 and 1."""
    p = F.greatest(F.least(c, F.lit(1 - least)), F.lit(least))
    return F.log(p / (1 - p))


def out_of_fold(df: DataFrame, key: str, features: list[str], label: Column, classes: tuple[str, ...], classifiers: dict[str, Callable[[], object]], k: int = 5, seed: int = 42, **weights: object) -> DataFrame:
    """``df`` with fold, label and {name}_pred, {name}_proba_{class} of every classifier, each row by models that never saw it."""
    rows = numeric(df, features).withColumn("label", label).filter(F.col("label").isin(*classes))
    rows = cut_lineage(stratified_folds(rows, key, "label", k, seed))
    parts = []
    for fold in range(k):
        rest, held = rows.filter(F.col("fold") != fold), rows.filter(F.col("fold") == fold)
        for name, made in classifiers.items():
            held = predict(fit(rest, features, F.col("label"), classes, made(), **weights), held, features, classes, name)
        parts.append(held)
    return cut_lineage(reduce(lambda a, b: a.unionByName(b), parts))


def blend_sweep(held: DataFrame, first: str, second: str, positive: str, weights: list[float], cuts: list[float]) -> DataFrame:
    """(weight, cut, n, accuracy) of blended out-of-fold probabilities of ``positive`` against the column label."""
    grid = F.array(*[F.struct(F.lit(w).alias("weight"), F.lit(c).alias("cut")) for w in weights for c in cuts])
    rows = held.select("label", F.col(f"{first}_proba_{positive}").alias("a"), F.col(f"{second}_proba_{positive}").alias("b"), F.explode(grid).alias("g")).select("label", "a", "b", "g.*")
    right = (blend(F.col("a"), F.col("b"), F.col("weight")) >= F.col("cut")) == (F.col("label") == positive)
    return rows.groupBy("weight", "cut").agg(F.count(F.lit(1)).alias("n"), F.avg(right.cast("double")).alias("accuracy"))


def grid_search(df: DataFrame, key: str, features: list[str], label: Column, classes: tuple[str, ...], grid: dict[str, Callable[[], object]], k: int = 3, **weights: object) -> DataFrame:
    """(name, n, accuracy, balanced_accuracy) of every point of a grid by out-of-fold predictions, best first."""
    held = out_of_fold(df, key, features, label, classes, grid, k, **weights)
    said = held.select("label", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"{n}_pred").alias("pred")) for n in grid])).alias("s")).select("label", "s.*")
    by = said.groupBy("name", "label").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("label") == F.col("pred")).cast("int")).alias("hits"))
    out = by.groupBy("name").agg(F.sum("n").alias("n"), (F.sum("hits") / F.sum("n")).alias("accuracy"), F.avg(F.col("hits") / F.col("n")).alias("balanced_accuracy"))
    return out.orderBy(F.col("balanced_accuracy").desc(), "name")


def save(model: PipelineModel, path: str) -> None:
    """Write a fitted model to a folder, in place of what is there."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    """A model that ``save`` wrote, for ``predict`` alone."""
    return PipelineModel.load(path)


def nearest_neighbours(queries: DataFrame, data: DataFrame, key: str, vector: str, label: str, k: int = 11, max_queries: int = 10_000) -> DataFrame:
    """(key, mean_label, nearest): the mean label of the k nearest rows by Euclidean distance.

    Queries are a stated set of at most ``max_queries`` vectors, held by every task; data is scanned once, each
    batch keeps k rows a query, and those are merged. Rows do not count as their own neighbours; ties go by key.
    """
    import numpy as np
    import pandas as pd

    from pairloom.session import bounded_rows

    asked = bounded_rows(queries.select(key, vector).filter(F.col(vector).isNotNull()), max_queries, "queries")
    ids = [r[0] for r in asked]
    matrix = np.array([r[1] for r in asked], np.float64).reshape(len(ids), -1)
    sent = data.sparkSession.sparkContext.broadcast((ids, matrix))
    kind = dict(data.dtypes)[key]

    def run(batches):  # noqa: ANN001, ANN202
        ids, matrix = sent.value
        for batch in batches:
            if not len(batch) or not ids:
                continue
            rows = np.stack(batch["v"].to_numpy()).astype(np.float64)
            keys, labels = batch["k"].to_numpy(), batch["l"].to_numpy().astype(float)
            distance = np.sqrt(np.maximum((matrix**2).sum(1)[:, None] + (rows**2).sum(1)[None, :] - 2 * matrix @ rows.T, 0))
            distance[np.array(ids, dtype=object)[:, None] == keys[None, :]] = np.inf
            n = min(k, len(rows))
            best = np.argsort(distance, 1, kind="stable")[:, :n]
            at = np.repeat(np.arange(len(ids)), n)
            near = best.ravel()
            keep = np.isfinite(distance[at, near])
            yield pd.DataFrame({"q": [ids[i] for i in at[keep]], "d": distance[at, near][keep], "k": keys[near[keep]], "l": labels[near[keep]]})

    found = data.filter(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v"), F.col(label).cast("double").alias("l")).mapInPandas(run, f"q {kind}, d double, k {kind}, l double")
    top = found.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "k", "l"))), 1, k).alias("n"))
    mean = F.aggregate("n", F.lit(0.0), lambda s, x: s + x["l"]) / F.size("n")
    return top.select(F.col("q").alias(key), mean.alias("mean_label"), F.get("n", F.lit(0))["k"].alias("nearest"))


def importances(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """Features by the weight the last stage gives them, largest first."""
    last = model.stages[-1]
    values = last.coefficients.toArray() if hasattr(last, "coefficients") else last.featureImportances.toArray()
    return sorted(zip(features, (float(v) for v in values), strict=True), key=lambda x: (-abs(x[1]), x[0]))


__all__ = [
    "aggregate_attributes", "balanced", "blend", "blend_sweep", "boosted", "fit", "fit_per_attribute", "forest", "grid_search", "importances", "load", "log_odds", "logistic", "nearest_neighbours", "numeric",
    "one_vs_rest", "out_of_fold", "predict", "predict_per_attribute", "save", "sigmoid", "stump",
]
