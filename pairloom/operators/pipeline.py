"""The whole decision pipeline, the report that compares it with golden, and the report on external truth."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions import labels as lb
from pairloom.functions import text as tx
from pairloom.functions.similarity import value_similarity
from pairloom.operators.features import MODEL_FEATURES, engineer_features
from pairloom.operators.metrics import class_metrics
from pairloom.operators.models import predict
from pairloom.operators.truth import all_or_any, comparable, side_value, winner_agreement
from pairloom.schemas import REFINER_CLASSES, THREE_CLASSES
from pairloom.session import cut_lineage


def run_pipeline(pairs: DataFrame, as_of: str, model: PipelineModel | None = None, features: tuple[str, ...] = MODEL_FEATURES, validate_phones: bool = False) -> DataFrame:
    """Prepared pairs with features, baseline_selection, model_3class_prediction (with a model) and final_prediction.

    The baseline takes the side of higher confidence, and both where the detector finds the sides alike. The model's
    word is final where there is one. Lines without a model follow the baseline.
    """
    rows = engineer_features(pairs, as_of, validate_phones=validate_phones)
    rows = rows.withColumn("baseline_selection", F.when(lb.both_detector(), "both").otherwise(lb.highest_confidence()))
    if model is None:
        return rows.withColumn("final_prediction", F.col("baseline_selection"))
    done = predict(model, rows, list(features), REFINER_CLASSES, "_m")
    done = done.withColumn("model_3class_prediction", F.col("_m_pred")).drop(*[c for c in done.columns if c.startswith("_m_")])
    return done.withColumn("final_prediction", F.coalesce("model_3class_prediction", "baseline_selection"))


def pipeline_report(decided: DataFrame, golden: DataFrame) -> DataFrame:
    """(strategy, n, accuracy, macro_f1, f1 by class) of every strategy of the pipeline on the golden rows."""
    truth = golden.select("id", lb.three_class_truth(F.col("3class_testlabels")).alias("t")).filter(F.col("t").isNotNull())
    names = [c for c in ("baseline_selection", "model_3class_prediction", "final_prediction") if c in decided.columns]
    said = decided.select("id", F.explode(F.array(*[F.struct(F.lit(c).alias("strategy"), F.col(c).alias("p")) for c in names])).alias("s")).select("id", "s.*")
    return class_metrics(said.join(truth, "id").filter(F.col("p").isNotNull()), "t", "p", THREE_CLASSES, by=["strategy"])


def threshold_accuracy(scored: DataFrame, golden: DataFrame, score: str, threshold: float) -> DataFrame:
    """(threshold, n, accuracy) of taking alt where the score reaches the threshold; other labels than base, alt are left out."""
    told = golden.select("id", F.col("golden_label").alias("__t")).distinct().filter(F.col("__t").isin("base", "alt"))
    rows = scored.select("id", score).join(told, "id")
    right = F.coalesce(F.col(score) >= threshold, F.lit(False)) == (F.col("__t") == "alt")
    return rows.agg(F.lit(threshold).alias("threshold"), F.count(F.lit(1)).alias("n"), F.avg(right.cast("double")).alias("accuracy"))


def best_feature_thresholds(df: DataFrame, label: str, columns: list[str], cells: int = 100) -> DataFrame:
    """(feature, threshold, accuracy): for each feature the lowest of ``cells`` steps of its extent that tells label 1 best."""
    extent = df.agg(*[F.min(c).alias(f"l_{c}") for c in columns], *[F.max(c).alias(f"h_{c}") for c in columns]).first()
    known = {c: (float(extent[f"l_{c}"]), float(extent[f"h_{c}"])) for c in columns if extent[f"l_{c}"] is not None}
    steps = [F.struct(F.lit(c).alias("feature"), F.least(F.floor((F.col(c) - lo) / ((hi - lo) or 1.0) * cells), F.lit(cells - 1)).alias("cell"), F.lit(lo).alias("lo"), F.lit((hi - lo) / cells).alias("step")) for c, (lo, hi) in known.items()]
    rows = df.select(F.col(label).alias("y"), F.explode(F.array(*steps)).alias("s")).select("y", "s.*").filter(F.col("cell").isNotNull() & F.col("y").isNotNull())
    counts = rows.groupBy("feature", "lo", "step", "cell").agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("pos"), F.count(F.lit(1)).alias("n"))
    # at most ``cells`` rows a feature from here on
    listed = counts.groupBy("feature", "lo", "step").agg(F.sort_array(F.collect_list(F.struct("cell", "pos", "n"))).alias("c"), F.sum("pos").alias("all_pos"), F.sum("n").alias("all_n"))
    below = lambda k, f: F.aggregate(F.filter("c", lambda x: x["cell"] < k), F.lit(0).cast("bigint"), lambda s, x: s + f(x))
    right = lambda k: F.col("all_pos") - below(k, lambda x: x["pos"]) + below(k, lambda x: x["n"] - x["pos"])
    scored = listed.withColumn("best", F.array_max(F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda k: F.struct((right(k) / F.col("all_n")).alias("accuracy"), (-k).alias("k")))))
    return scored.select("feature", (F.col("lo") - F.col("best.k") * F.col("step")).alias("threshold"), F.col("best.accuracy").alias("accuracy"))


def _mean(flag: Column) -> Column:
    return F.avg(F.coalesce(flag, F.lit(False)).cast("double"))


def verify_report(df: DataFrame) -> DataFrame:
    """(section, attribute, measure, value): external truth (``truth_*`` columns) against golden winners and both sides.

    Sections: similarity (mean 0-100 of the normal truth value and the value golden selects), match (share equal),
    place (share whose value is that of base only, alt only, both, neither), winner (counts agree, disagree,
    suggested), record (share of all equal, agreement and cells of the 2-class labels).
    """
    attributes = lb.TRUTH_ATTRIBUTES
    sides = {a: {s: comparable(a, side_value(df, a, s == "base")) for s in ("base", "alt")} for a in attributes}
    told = [F.col(f"truth_{a}_{x}") for a in attributes for x in ("winner", "value_norm")] + [F.col(f"attr_{a}_winner") for a in attributes]
    # each step is written, as forms and kernels would else be worked out again wherever they are named
    df = cut_lineage(df.select("2class_testlabels", *told, *[c.alias(f"_{a}_{s}") for a, both in sides.items() for s, c in both.items()]))
    golden = {a: lb.golden_value(F.col(f"attr_{a}_winner"), F.col(f"_{a}_base"), F.col(f"_{a}_alt")) for a in attributes}
    df = df.withColumns({f"_{a}_golden": F.coalesce(g, F.lit("")) for a, g in golden.items()})
    df = df.withColumns({f"_{a}_sim": value_similarity(a, F.col(f"truth_{a}_value_norm"), F.col(f"_{a}_golden")) for a in attributes})
    df = cut_lineage(df.withColumns({f"_{a}_agree": winner_agreement(f"truth_{a}_winner", f"attr_{a}_winner") for a in attributes}))
    cells: list[tuple[str, str, str, Column]] = []
    for a in attributes:
        t, at_base, at_alt = F.col(f"truth_{a}_value_norm"), F.col(f"truth_{a}_value_norm") == F.col(f"_{a}_base"), F.col(f"truth_{a}_value_norm") == F.col(f"_{a}_alt")
        cells += [("similarity", a, "mean", F.avg(f"_{a}_sim")), ("match", a, "share", _mean(F.col(f"_{a}_sim") >= 100))]
        cells += [("place", a, m, _mean(c & t.isNotNull())) for m, c in (("base", at_base & ~at_alt), ("alt", at_alt & ~at_base), ("both", at_base & at_alt), ("neither", ~at_base & ~at_alt))]
        cells += [("winner", a, m, F.sum((F.col(f"_{a}_agree") == m).cast("double"))) for m in ("agree", "disagree", "suggested")]
    every = reduce(lambda x, y: x & y, [F.col(f"_{a}_sim") >= 100 for a in attributes])
    overall = reduce(lambda x, y: x + y, [F.col(f"_{a}_sim") for a in attributes]) / len(attributes)
    rule, told = lb.truth_2class(), tx.stripped(F.lower("2class_testlabels"))
    cells += [("record", "all", "match", _mean(every)), ("record", "all", "similarity", F.avg(overall)), ("record", "2class", "agree", _mean(rule == told))]
    cells += [("record", "2class", f"{g}_{p}", F.sum(((told == g) & (rule == p)).cast("double"))) for g in ("base", "alt") for p in ("base", "alt")]
    one = df.agg(*[F.coalesce(c, F.lit(0.0)).alias(f"c{i}") for i, (_, _, _, c) in enumerate(cells)])
    rows = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(a).alias("attribute"), F.lit(m).alias("measure"), F.col(f"c{i}").alias("value")) for i, (s, a, m, _) in enumerate(cells)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def disagreements(df: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` ids at which truth and golden name different winners, with the attributes concerned."""
    said = [F.when(winner_agreement(f"truth_{a}_winner", f"attr_{a}_winner") == "disagree", F.lit(a)) for a in lb.TRUTH_ATTRIBUTES]
    rows = df.select("id", F.array_join(F.array_compact(F.array(*said)), ",").alias("attributes")).filter(F.col("attributes") != "")
    return rows.distinct().orderBy("id", "attributes").limit(n)


__all__ = ["all_or_any", "best_feature_thresholds", "disagreements", "pipeline_report", "run_pipeline", "threshold_accuracy", "verify_report"]
