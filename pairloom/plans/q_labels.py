"""Queries on winners, record labels and measures of classifications."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import labels as lb
from pairloom.operators import metrics as me
from pairloom.operators import profile as pr
from pairloom.plans import sqltext as q
from pairloom.schemas import ATTRIBUTES, FOUR_CLASSES, THREE_CLASSES
from pairloom.sources.tables import table

GRID = me.thresholds(0.15, 0.85, 0.05)


def _golden(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "golden_dataset_200")


def _phase3(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "phase3_slm_labeled")


def _checked(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "incorrect_predictions")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(c), 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _simple(expression, source: str = "golden_dataset_200", name: str = "label"):  # noqa: ANN001, ANN202
    return lambda spark, folder: table(spark, folder, source).select("id", expression().alias(name))


def label_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """Share of each 4-class label over the training split."""
    return _rounded(pr.value_shares(_phase3(spark, folder), lb.label_4class(), FOUR_CLASSES))


def winner_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The name winners of golden as written and in both normal forms."""
    w = F.col("attr_name_winner")
    return _golden(spark, folder).groupBy(w.alias("written"), lb.winner_strict(w).alias("strict"), lb.winner_lenient(w).alias("lenient")).agg(F.count(F.lit(1)).alias("n"))


def binary_maps(spark: SparkSession, folder: str) -> DataFrame:
    """The binary forms of the checked labels, counted."""
    t = F.col("truth_4class")
    cells = {"or_null": lb.binary_or_null(t), "or_zero": lb.binary_or_zero(t), "alt_only": lb.binary_alt_only(t), "name": lb.binary_name(t)}
    return _checked(spark, folder).select(t.alias("label"), *[c.alias(k) for k, c in cells.items()]).groupBy("label", *cells).agg(F.count(F.lit(1)).alias("n"))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    w = lb.winner_strict(F.col("attr_address_winner"))
    return _phase3(spark, folder).select("id", (F.round(F.col("addr_similarity_ratio"), 4) / 100.0).alias("score"), F.when(w.isin("base", "both"), 1).otherwise(0).alias("label"), w.alias("winner"))


def _agreement(spark: SparkSession, folder: str) -> DataFrame:
    return me.attribute_agreement(_checked(spark, folder), {a: (lb.real_as_alt(F.col(f"attr_{a}_winner_truth")), lb.real_as_alt(F.col(f"attr_{a}_winner_slm"))) for a in ATTRIBUTES})


def _methods(spark: SparkSession, folder: str) -> DataFrame:
    golden, p3, p1 = _golden(spark, folder), _phase3(spark, folder), table(spark, folder, "phase1_processed")
    methods = {
        "confidence": (p1, lb.highest_confidence()), "model_label": (p3, F.lower(F.trim("golden_label"))), "model_recalculated": (p3, lb.label_3class()), "always_base": (p1, F.lit("base")),
    }
    return me.evaluate_methods(golden, "id", lb.three_class_truth(F.col("3class_testlabels")), methods, THREE_CLASSES)


def _strategies(spark: SparkSession, folder: str) -> DataFrame:
    return me.strategy_agreement(_checked(spark, folder), ATTRIBUTES, "attr_{}_winner_truth", "attr_{}_winner_slm")


QUERIES = {
    "label_4class": _simple(lb.label_4class), "label_3class": _simple(lb.label_3class), "label_2class": _simple(lb.label_2class), "label_4class_legacy": _simple(lb.label_4class_legacy),
    "label_4class_truth": _simple(lambda: lb.label_4class("_truth"), "incorrect_predictions"), "label_4class_slm": _simple(lambda: lb.label_4class("_slm"), "incorrect_predictions"),
    "label_distribution": label_distribution, "winner_forms": winner_forms, "binary_maps": binary_maps,
    "confidence_baseline": lambda s, d: table(s, d, "phase1_processed").select("id", lb.highest_confidence().alias("selection")).groupBy("selection").agg(F.count(F.lit(1)).alias("n")),
    "golden_values": lambda s, d: _golden(s, d).select("id", lb.golden_value(F.col("attr_phone_winner"), F.col("norm_base_phone"), F.col("norm_conflated_phone")).alias("phone")),
    "similarity_labels": lambda s, d: table(s, d, "phase1_processed").select(lb.similarity_label(F.col("addr_token_sort") / 100, F.col("addr_similarity_ratio") / 100).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n")),
    "metrics_3class": lambda s, d: _rounded(me.class_metrics(_checked(s, d), "truth_3class", "slm_3class", THREE_CLASSES)),
    "metrics_4class": lambda s, d: _rounded(me.class_metrics(_checked(s, d), "truth_4class", "slm_4class", FOUR_CLASSES)),
    "metrics_binary": lambda s, d: _rounded(me.binary_metrics(_checked(s, d).select(lb.binary_name(F.col("truth_4class")).alias("t"), lb.binary_name(F.col("slm_4class")).alias("p")), "t", "p")),
    "confusion_cells": lambda s, d: me.confusion(_checked(s, d), "truth_4class", "slm_4class"),
    "confusion_matrix": lambda s, d: me.confusion_matrix(_checked(s, d), "truth_4class", "slm_4class", FOUR_CLASSES),
    "class_report": lambda s, d: _rounded(me.class_report(_checked(s, d), "truth_4class", "slm_4class", FOUR_CLASSES)),
    "attribute_agreement": lambda s, d: _rounded(_agreement(s, d)), "pooled_agreement": lambda s, d: _rounded(me.pooled(_agreement(s, d))),
    "strategy_agreement": lambda s, d: _rounded(_strategies(s, d)), "best_strategy": lambda s, d: _rounded(me.best_by(_strategies(s, d), "agreement", "strategy")),
    "method_metrics": lambda s, d: _rounded(_methods(s, d)), "best_method": lambda s, d: _rounded(me.best_by(_methods(s, d), "accuracy", "method")),
    "threshold_sweep": lambda s, d: _rounded(me.threshold_sweep(_scored(s, d), "score", "label", GRID)), "best_threshold": lambda s, d: _rounded(me.best_threshold(me.threshold_sweep(_scored(s, d), "score", "label", GRID), "accuracy")),
    "precision_recall_curve": lambda s, d: _rounded(me.precision_recall_curve(_scored(s, d), "score", "label")), "roc_auc": lambda s, d: _rounded(me.roc_auc(_scored(s, d), "score", "label")),
    "log_loss": lambda s, d: _rounded(me.log_loss(_scored(s, d), "score", "label")),
    "cascade_sweep": lambda s, d: me.cascade_sweep(_scored(s, d), "score", "winner", "winner", me.thresholds(0.1, 0.9, 0.1)),
    "class_weights": lambda s, d: _rounded(pr.class_weights(_phase3(s, d).select(lb.label_4class().alias("l")), "l")), "positive_weight": lambda s, d: _rounded(pr.positive_weight(_phase3(s, d).select(lb.label_2class().alias("l")), "l")),
}

_CHECKED = "incorrect_predictions"
_LABELLED = f"(SELECT truth_4class AS t, slm_4class AS p FROM {_CHECKED})"
_SCORED = f"(SELECT id, round(addr_similarity_ratio, 4) / 100.0 AS score, CASE WHEN {q.strict('attr_address_winner')} IN ('base','both') THEN 1 ELSE 0 END AS label, {q.strict('attr_address_winner')} AS winner FROM phase3_slm_labeled)"
_NAME = "CASE WHEN {0} IN ('alt','both') THEN 'alt' ELSE 'base' END"
_AGREE = "SELECT attribute, CAST(count(*) AS BIGINT) AS n, avg(CASE WHEN t = p THEN 1.0 ELSE 0.0 END) AS agreement FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS attribute, CASE WHEN {q.plain(f'attr_{a}_winner_truth')} = 'real' THEN 'alt' ELSE {q.plain(f'attr_{a}_winner_truth')} END AS t, CASE WHEN {q.plain(f'attr_{a}_winner_slm')} = 'real' THEN 'alt' ELSE {q.plain(f'attr_{a}_winner_slm')} END AS p FROM {_CHECKED}" for a in ATTRIBUTES
) + ") WHERE t <> '' GROUP BY attribute"
_STRATEGY = "SELECT strategy, avg(a) AS agreement FROM (SELECT strategy, attribute, avg(CASE WHEN g = s THEN 1.0 ELSE 0.0 END) AS a FROM (" + " UNION ALL ".join(
    f"SELECT '{name}' AS strategy, '{a}' AS attribute, {q.plain(f'attr_{a}_winner_truth')} AS g, {said} AS s FROM {_CHECKED}"
    for a in ATTRIBUTES for name, said in (("always_base", "'base'"), ("always_alt", "'alt'"), ("pipeline", f"CASE WHEN {q.plain(f'attr_{a}_winner_slm')} = 'real' THEN 'alt' ELSE {q.plain(f'attr_{a}_winner_slm')} END"))
) + ") WHERE g <> '' GROUP BY strategy, attribute) GROUP BY strategy"
_CONFIDENCE = "CASE WHEN coalesce(CASE WHEN NOT isnan(confidence) THEN confidence END, -1.0) > coalesce(CASE WHEN NOT isnan(base_confidence) THEN base_confidence END, CAST('infinity' AS DOUBLE)) THEN 'alt' ELSE 'base' END"
_METHODS = q.class_metrics(
    f"""(SELECT m.method, g.t, m.p FROM (SELECT id, CASE WHEN {q.plain('"3class_testlabels"')} = 'match' THEN 'alt' ELSE {q.plain('"3class_testlabels"')} END AS t FROM golden_dataset_200) g
  JOIN (SELECT 'confidence' AS method, id, {_CONFIDENCE} AS p FROM phase1_processed UNION ALL SELECT 'always_base', id, 'base' FROM phase1_processed
        UNION ALL SELECT 'model_label', id, lower(trim(golden_label)) FROM phase3_slm_labeled UNION ALL SELECT 'model_recalculated', id, {q.THREE} FROM {q.winners('phase3_slm_labeled', '', 'lenient')}) m USING (id)
  WHERE g.t IN ('alt','both','base'))""", THREE_CLASSES, "method")  # fmt: skip
_GRID = "(SELECT unnest([" + ", ".join(f"CAST({t!r} AS DOUBLE)" for t in GRID) + "]) AS threshold)"
_SWEEP = f"""SELECT threshold, CAST(count(*) AS BIGINT) AS n, round({q.share('sum(CASE WHEN (score >= threshold) = (label = 1) THEN 1 ELSE 0 END)', 'count(*)')}, 6) AS accuracy,
  round(({q.share('sum(CASE WHEN score >= threshold AND label = 1 THEN 1 ELSE 0 END)', 'sum(label)')} + {q.share('sum(CASE WHEN score < threshold AND label = 0 THEN 1 ELSE 0 END)', 'sum(1 - label)')}) / 2, 6) AS balanced_accuracy,
  round({q.f1('sum(CASE WHEN score >= threshold AND label = 1 THEN 1 ELSE 0 END)', 'sum(CASE WHEN score >= threshold AND label = 0 THEN 1 ELSE 0 END)', 'sum(CASE WHEN score < threshold AND label = 1 THEN 1 ELSE 0 END)')}, 6) AS f1
  FROM {_SCORED}, {_GRID} WHERE score IS NOT NULL GROUP BY threshold"""
_CELLS = "SELECT truth_4class AS truth, slm_4class AS pred, CAST(count(*) AS BIGINT) AS n FROM incorrect_predictions GROUP BY 1, 2"
_FOUR_LIST = "(SELECT unnest(['none','alt','base','both']) AS label)"

ORACLES = {
    "label_4class": f"SELECT id, {q.FOUR} AS label FROM {q.winners('golden_dataset_200', '', 'lenient')}", "label_3class": f"SELECT id, {q.THREE} AS label FROM {q.winners('golden_dataset_200', '', 'lenient')}",
    "label_2class": f"SELECT id, {q.TWO} AS label FROM {q.winners('golden_dataset_200', '', 'strict')}", "label_4class_legacy": f"SELECT id, {q.LEGACY} AS label FROM {q.winners('golden_dataset_200', '', 'legacy')}",
    "label_4class_truth": "SELECT id, truth_4class AS label FROM incorrect_predictions", "label_4class_slm": "SELECT id, slm_4class AS label FROM incorrect_predictions",
    "label_distribution": f"SELECT l.label AS value, CAST(coalesce(n, 0) AS BIGINT) AS n, round(coalesce(n, 0) * 100.0 / sum(coalesce(n, 0)) OVER (), 6) AS pct FROM {_FOUR_LIST} l LEFT JOIN (SELECT {q.FOUR} AS label, count(*) AS n FROM {q.winners('phase3_slm_labeled', '', 'lenient')} GROUP BY 1) USING (label)",
    "winner_forms": f"SELECT attr_name_winner AS written, {q.strict('attr_name_winner')} AS strict, {q.lenient('attr_name_winner')} AS lenient, CAST(count(*) AS BIGINT) AS n FROM golden_dataset_200 GROUP BY 1, 2, 3",
    "binary_maps": f"SELECT truth_4class AS label, CASE WHEN {q.plain('truth_4class')} IN ('alt','match','both') THEN 1 WHEN {q.plain('truth_4class')} IN ('base','none') THEN 0 END AS or_null, CASE WHEN {q.plain('truth_4class')} IN ('alt','both') THEN 1 ELSE 0 END AS or_zero, CASE WHEN {q.plain('truth_4class')} IN ('alt','match') THEN 1 ELSE 0 END AS alt_only, {_NAME.format(q.plain('truth_4class'))} AS name, CAST(count(*) AS BIGINT) AS n FROM incorrect_predictions GROUP BY ALL",
    "confidence_baseline": f"SELECT {_CONFIDENCE} AS selection, CAST(count(*) AS BIGINT) AS n FROM phase1_processed GROUP BY 1",
    "golden_values": f"SELECT id, CASE WHEN {q.strict('attr_phone_winner')} = 'alt' THEN norm_conflated_phone ELSE norm_base_phone END AS phone FROM golden_dataset_200",
    "similarity_labels": "SELECT CASE WHEN addr_token_sort / 100 >= 0.8 AND addr_similarity_ratio / 100 >= 0.78 THEN 1 WHEN addr_token_sort / 100 < 0.8 AND addr_similarity_ratio / 100 < 0.78 THEN 0 END AS label, CAST(count(*) AS BIGINT) AS n FROM phase1_processed GROUP BY 1",
    "metrics_3class": q.class_metrics(f"(SELECT truth_3class AS t, slm_3class AS p FROM {_CHECKED})", THREE_CLASSES), "metrics_4class": q.class_metrics(_LABELLED, FOUR_CLASSES),
    "metrics_binary": f"""SELECT CAST(tp + fp + fn + tn AS BIGINT) AS n, round({q.share('tp + tn', 'tp + fp + fn + tn')}, 6) AS accuracy, round({q.share('tp', 'tp + fp')}, 6) AS precision, round({q.share('tp', 'tp + fn')}, 6) AS recall, round({q.f1('tp', 'fp', 'fn')}, 6) AS f1,
      CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn FROM (SELECT sum(CASE WHEN t = 'alt' AND p = 'alt' THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN t = 'base' AND p = 'alt' THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN t = 'alt' AND p = 'base' THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN t = 'base' AND p = 'base' THEN 1 ELSE 0 END) AS tn
      FROM (SELECT {_NAME.format(q.plain('truth_4class'))} AS t, {_NAME.format(q.plain('slm_4class'))} AS p FROM {_CHECKED}))""",
    "confusion_cells": _CELLS,
    "confusion_matrix": "SELECT label AS truth, " + ", ".join(f"CAST(coalesce(sum(CASE WHEN pred = '{x}' THEN n END), 0) AS BIGINT) AS pred_{x}" for x in FOUR_CLASSES) + f" FROM {_FOUR_LIST} l LEFT JOIN ({_CELLS}) c ON c.truth = l.label GROUP BY label",
    "class_report": f"""SELECT label, round({q.share('tp', 'said')}, 6) AS precision, round({q.share('tp', 'support')}, 6) AS recall, round({q.f1('tp', 'said - tp', 'support - tp')}, 6) AS f1, CAST(support AS BIGINT) AS support
      FROM (SELECT label, sum(CASE WHEN t = label AND p = label THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN p = label THEN 1 ELSE 0 END) AS said, sum(CASE WHEN t = label THEN 1 ELSE 0 END) AS support FROM {_FOUR_LIST} l, {_LABELLED} x GROUP BY label)""",
    "attribute_agreement": f"SELECT attribute, n, round(agreement, 6) AS agreement FROM ({_AGREE})", "pooled_agreement": f"SELECT round(avg(agreement), 6) AS agreement, CAST(sum(n) AS BIGINT) AS n FROM ({_AGREE})",
    "strategy_agreement": f"SELECT strategy, round(agreement, 6) AS agreement FROM ({_STRATEGY})", "best_strategy": f"SELECT strategy, round(agreement, 6) AS agreement FROM ({_STRATEGY}) ORDER BY agreement DESC, strategy LIMIT 1",
    "method_metrics": _METHODS, "best_method": f"SELECT * FROM ({_METHODS}) ORDER BY accuracy DESC, method LIMIT 1",
    "threshold_sweep": _SWEEP, "best_threshold": f"SELECT * FROM ({_SWEEP}) ORDER BY accuracy DESC, threshold LIMIT 1",
    "precision_recall_curve": f"""SELECT round(threshold, 6) AS threshold, round({q.share('tp', 'said')}, 6) AS precision, round({q.share('tp', 'support')}, 6) AS recall, round({q.f1('tp', 'said - tp', 'support - tp')}, 6) AS f1
      FROM (SELECT score AS threshold, sum(pos) OVER w AS tp, sum(n) OVER w AS said, sum(pos) OVER () AS support FROM (SELECT score, sum(label) AS pos, count(*) AS n FROM {_SCORED} WHERE score IS NOT NULL GROUP BY score) WINDOW w AS (ORDER BY score DESC))""",
    "roc_auc": f"SELECT round(CASE WHEN p * n = 0 THEN NULL ELSE wins / (p * n) END, 6) AS auc FROM (SELECT sum(pos * (below + neg / 2.0)) AS wins, sum(pos) AS p, sum(neg) AS n FROM (SELECT pos, neg, sum(neg) OVER (ORDER BY score) - neg AS below FROM (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM {_SCORED} WHERE score IS NOT NULL GROUP BY score)))",
    "log_loss": f"SELECT round(avg(CASE WHEN label = 1 THEN -ln(p) ELSE -ln(1 - p) END), 6) AS log_loss FROM (SELECT label, least(greatest(score, 1e-15), 1 - 1e-15) AS p FROM {_SCORED})",
    "cascade_sweep": f"SELECT threshold, CAST(sum(CASE WHEN (winner = 'base' AND said = 'none') OR (winner = 'none' AND said = 'base') THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM (SELECT threshold, winner, CASE WHEN floor(score * 1000000) >= floor(threshold * 1000000) THEN 'none' ELSE winner END AS said FROM {_SCORED}, (SELECT unnest([" + ", ".join(f"CAST({t!r} AS DOUBLE)" for t in me.thresholds(0.1, 0.9, 0.1)) + "]) AS threshold) WHERE score IS NOT NULL) GROUP BY threshold",
    "class_weights": f"SELECT label, n, round(least(sum(n) OVER () / (count(*) OVER () * n), 10.0), 6) AS weight FROM (SELECT {q.FOUR} AS label, CAST(count(*) AS BIGINT) AS n FROM {q.winners('phase3_slm_labeled', '', 'lenient')} GROUP BY 1)",
    "positive_weight": f"SELECT round(least(CAST(sum(CASE WHEN l = 'base' THEN 1 ELSE 0 END) AS DOUBLE) / sum(CASE WHEN l = 'alt' THEN 1 ELSE 0 END), 10.0), 6) AS weight FROM (SELECT {q.TWO} AS l FROM {q.winners('phase3_slm_labeled', '', 'strict')})",
}
