"""Queries on profiles, joins, sets, samples and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import labels as lb
from pairloom.operators import features as fe
from pairloom.operators import joins as jn
from pairloom.operators import models as mo
from pairloom.operators import profile as pr
from pairloom.operators import sampling as sa
from pairloom.schemas import FOUR_CLASSES, REFINER_CLASSES, domain_offenders
from pairloom.sources.tables import table

AS_OF = "2026-01-01"
SCORES = ["addr_similarity_ratio", "addr_token_sort", "phone_similarity", "website_similarity"]
FEATURES = list(fe.MODEL_FEATURES)

#: Sizes and weights of the reference's models, where it searches a grid one point of that grid.
BOOSTED, FOREST, ATTRIBUTE_FOREST, REST = {"rounds": 150, "rate": 0.05}, {"trees": 200, "depth": 12}, {"trees": 160, "depth": 4}, {"rounds": 100, "depth": 3, "subsample": 0.8}
REFINER_WEIGHTS, MOST_WEIGHT = {"alt": 1.5, "base": 1.5, "both": 1.0}, 10.0


def _t(name: str):  # noqa: ANN202
    return lambda spark, folder: table(spark, folder, name)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(c), 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


raw, p1, p3, golden, checked = _t("project_a_samples"), _t("phase1_processed"), _t("phase3_slm_labeled"), _t("golden_dataset_200"), _t("incorrect_predictions")


def drift(spark: SparkSession, folder: str) -> DataFrame:
    """Drift of the training split against all pairs."""
    return _rounded(pr.mean_drift(p1(spark, folder), p3(spark, folder), SCORES))


def correlations(spark: SparkSession, folder: str) -> DataFrame:
    """Scores against the address winner being base or both."""
    w = lb.winner_strict(F.col("attr_address_winner"))
    rows = p3(spark, folder).select(F.when(w.isin("base", "both"), 1).otherwise(0).alias("y"), *SCORES)
    return _rounded(pr.correlations(rows, "y", SCORES))


def _training(spark: SparkSession, folder: str) -> DataFrame:
    return fe.engineer_features(p3(spark, folder), AS_OF, validate_phones=True)


def _test(spark: SparkSession, folder: str) -> DataFrame:
    return fe.engineer_features(golden(spark, folder), AS_OF, validate_phones=True)


def _fitted(classifier, classes: tuple[str, ...], label, scale: bool = False, **weights):  # noqa: ANN001, ANN003, ANN202
    def run(spark: SparkSession, folder: str) -> DataFrame:
        model = mo.fit(_training(spark, folder), FEATURES, label(), classes, classifier(), scale, **weights)
        done = mo.predict(model, _test(spark, folder), FEATURES, classes, "model")
        return done.select("id", *[c for c in done.columns if c.startswith("model_")])

    return run


def attribute_models(spark: SparkSession, folder: str) -> DataFrame:
    """Winners of all attributes by one model each, and the record labels that follow."""
    models = mo.fit_per_attribute(_training(spark, folder), FEATURES, lambda: mo.forest(**ATTRIBUTE_FOREST))
    done = mo.predict_per_attribute(models, _test(spark, folder), FEATURES)
    return done.select("id", *[c for c in done.columns if c.endswith("_model")])


def neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Mean label of the 11 nearest vectors of every vector whose id is divisible by 20."""
    data = table(spark, folder, "embeddings")
    return _rounded(mo.nearest_neighbours(data.filter(F.col("vec_id") % 20 == 0), data, "vec_id", "embedding", "label"))


def folds(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each class in each fold."""
    rows = p3(spark, folder).withColumn("label", lb.label_4class())
    return sa.stratified_folds(rows, "id", "label").groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))


def synthetic(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of golden with made-up rare classes, counted."""
    return sa.synthetic_labels(golden(spark, folder), n_none=None, none_share=0.35).groupBy(F.col("4class_testlabels").alias("label")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "row_count": lambda s, d: raw(s, d).agg(F.count(F.lit(1)).alias("n")), "table_schema": lambda s, d: pr.describe_schema(p1(s, d)), "null_profile": lambda s, d: _rounded(pr.null_profile(p1(s, d))),
    "confidence_histogram": lambda s, d: pr.rounded_histogram(raw(s, d), "confidence"), "confidence_top10": lambda s, d: pr.top_counts(raw(s, d), F.round("confidence", 2), 10), "confidence_extent": lambda s, d: _rounded(pr.extent(raw(s, d), "confidence")),
    "distinct_counts": lambda s, d: pr.distinct_counts(p1(s, d), ["id", "base_id", "norm_conflated_phone"]), "repeated_bases": lambda s, d: pr.repeated(raw(s, d), "base_id"), "repeated_bases_top5": lambda s, d: pr.repeated(raw(s, d), "base_id", 5),
    "mean_scores": lambda s, d: _rounded(pr.means(p1(s, d), SCORES)), "score_buckets": lambda s, d: pr.bucket_histogram(p1(s, d), "addr_similarity_ratio"), "label_shares": lambda s, d: _rounded(pr.value_shares(p3(s, d), "golden_label", ("alt", "base", "abstain", "both"))),
    "class_stats": lambda s, d: _rounded(pr.class_stats(p3(s, d), "golden_label", SCORES)), "score_quantile": lambda s, d: _rounded(pr.quantile(p1(s, d), "addr_similarity_ratio", 0.1)), "drift": drift, "correlations": correlations,
    "filled_counts": lambda s, d: _rounded(pr.filled_counts(golden(s, d), {"base": ["norm_base_phone", "norm_base_website", "norm_base_addr"], "alt": ["norm_conflated_phone", "norm_conflated_website", "norm_conflated_addr"]})),
    "ids_only_in_samples": lambda s, d: pr.keys_only_in(raw(s, d), p1(s, d), "id"), "ids_only_in_training": lambda s, d: pr.keys_only_in(p3(s, d), raw(s, d), "id"), "columns_with_match": lambda s, d: pr.columns_with(golden(s, d), "match"),
    "differing_winners": lambda s, d: pr.differing_cells(checked(s, d).select("id", F.col("truth_3class").alias("three"), F.col("truth_4class").alias("four")).distinct(), checked(s, d).select("id", F.col("slm_3class").alias("three"), F.col("slm_4class").alias("four")).distinct(), "id", ["three", "four"]),
    "domain_offenders": lambda s, d: domain_offenders(golden(s, d), {"3class_testlabels": ("alt", "base", "both"), "attr_web_winner": ("base", "alt", "both", "none")}),
    "join_suffixes": lambda s, d: jn.with_suffixes(golden(s, d).select("id", "golden_label"), p3(s, d).select("id", "golden_label"), "id", "_golden", "_training"), "golden_in_samples": lambda s, d: jn.only_in(golden(s, d).select("id", "split"), raw(s, d), "id"),
    "unlabelled_pairs": lambda s, d: jn.not_in(p1(s, d).select("id"), p3(s, d), "id"), "golden_flag": lambda s, d: jn.flagged(p1(s, d).select("id"), golden(s, d), "id", "is_golden").groupBy("is_golden").agg(F.count(F.lit(1)).alias("n")),
    "looked_up_split": lambda s, d: jn.looked_up(p1(s, d).select("id"), golden(s, d), "id", "split", "split", "none").groupBy("split").agg(F.count(F.lit(1)).alias("n")),
    "all_ids": lambda s, d: raw(s, d).select("id").union(p3(s, d).select("id")), "shared_ids": lambda s, d: raw(s, d).select("id").intersect(p3(s, d).select("id")), "ids_without_labels": lambda s, d: raw(s, d).select("id").subtract(p3(s, d).select("id")), "distinct_pairs": lambda s, d: raw(s, d).select("id", "base_id").distinct(),
    "first_per_base": lambda s, d: sa.first_per_key(raw(s, d).filter("base_id IS NOT NULL").select("base_id", "id"), ["base_id"], ["id"]), "first_pairs": lambda s, d: sa.first_rows(raw(s, d).select("id", "base_id").distinct(), ["id", "base_id"], 20),
    "hard_cases": lambda s, d: sa.hard_cases(p1(s, d)).select("id", F.round("addr_similarity_ratio", 6).alias("score")), "hard_negatives": lambda s, d: sa.hard_negatives(raw(s, d)), "random_negatives": lambda s, d: sa.random_negatives(raw(s, d)),
    "stratified_folds": folds, "hash_split": lambda s, d: sa.hash_split(p3(s, d).select("id"), "id"), "sampled_pairs": lambda s, d: sa.sample_rows(raw(s, d).select("id", "base_id").distinct(), "id", 100), "synthetic_labels": synthetic,
    "nearest_labels": neighbours, "logistic_scores": _fitted(mo.logistic, ("base", "alt"), lb.label_2class, True), "stump_scores": _fitted(mo.stump, ("base", "alt"), lb.label_2class), "boosted_scores": _fitted(lambda: mo.boosted(**BOOSTED), ("base", "alt"), lb.label_2class),
    "forest_scores": _fitted(lambda: mo.forest(**FOREST), ("base", "alt"), lb.label_2class, weights="balanced"), "refiner_scores": _fitted(lambda: mo.forest(**FOREST), REFINER_CLASSES, lb.label_3class, weights=REFINER_WEIGHTS), "four_class_scores": _fitted(lambda: mo.one_vs_rest(**REST), FOUR_CLASSES, lb.label_4class, weights="balanced", cap=MOST_WEIGHT),
    "attribute_models": attribute_models,
}

_PAIR = ("id", "sources", "names", "categories", "confidence", "websites", "socials", "emails", "phones", "brand", "addresses")
_PHASE1 = [p + c for p in ("", "base_") for c in _PAIR] + [f"norm_{s}_{x}" for x in ("addr", "phone", "website") for s in ("conflated", "base")] + SCORES
_WINNER = "lower(regexp_replace(attr_address_winner, '^\\s+|\\s+$', '', 'g'))"
_YES = f"(CASE WHEN {_WINNER} IN ('base','b','both','t') THEN 1 ELSE 0 END)"
_CELLS = "SELECT truth_3class AS a3, truth_4class AS a4, slm_3class AS b3, slm_4class AS b4, id FROM incorrect_predictions"
_PLAIN_LABEL = "lower(regexp_replace(CAST({0} AS VARCHAR), '^\\s+|\\s+$', '', 'g'))"
_SIDE = "CASE WHEN trim(coalesce({0}, '')) <> '' THEN 1 ELSE 0 END"

ORACLES = {
    "null_profile": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null, round(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) * 100.0 / count(*), 6) AS pct_null FROM phase1_processed" for c in _PHASE1),
    "correlations": " UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr({c}, y), 6) AS correlation, round(avg(CASE WHEN y = 1 THEN {c} END), 6) AS mean_1, round(avg(CASE WHEN y = 0 THEN {c} END), 6) AS mean_0 FROM (SELECT *, {_YES} AS y FROM phase3_slm_labeled)" for c in SCORES),
    "differing_winners": " UNION ALL ".join(f"SELECT '{n}' AS \"column\", CAST(sum(CASE WHEN a.x IS NOT DISTINCT FROM b.x THEN 0 ELSE 1 END) AS BIGINT) AS n FROM (SELECT DISTINCT id, a3, a4, a{k} AS x FROM ({_CELLS})) a JOIN (SELECT DISTINCT id, b3, b4, b{k} AS x FROM ({_CELLS})) b USING (id)" for n, k in (("three", 3), ("four", 4))),
    "row_count": "SELECT CAST(count(*) AS BIGINT) AS n FROM project_a_samples",
    "confidence_histogram": "SELECT CAST(round(CAST(confidence AS DECIMAL(18, 6)), 2) AS DOUBLE) AS value, CAST(count(*) AS BIGINT) AS n FROM project_a_samples WHERE confidence IS NOT NULL GROUP BY 1",
    "confidence_top10": "SELECT CAST(round(CAST(confidence AS DECIMAL(18, 6)), 2) AS DOUBLE) AS value, CAST(count(*) AS BIGINT) AS n FROM project_a_samples WHERE confidence IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 10",
    "confidence_extent": "SELECT CAST(count(*) AS BIGINT) AS n, round(min(confidence), 6) AS lowest, round(max(confidence), 6) AS highest, round(avg(confidence), 6) AS mean FROM project_a_samples WHERE confidence IS NOT NULL",
    "distinct_counts": "SELECT 'id' AS \"column\", CAST(count(DISTINCT id) AS BIGINT) AS n_distinct FROM phase1_processed UNION ALL SELECT 'base_id', count(DISTINCT base_id) FROM phase1_processed UNION ALL SELECT 'norm_conflated_phone', count(DISTINCT norm_conflated_phone) FROM phase1_processed",
    "repeated_bases": "SELECT base_id AS value, CAST(count(*) AS BIGINT) AS n FROM project_a_samples GROUP BY 1 HAVING count(*) > 1", "repeated_bases_top5": "SELECT base_id AS value, CAST(count(*) AS BIGINT) AS n FROM project_a_samples GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, value LIMIT 5",
    "mean_scores": "SELECT " + ", ".join(f"round(avg({c}), 6) AS avg_{c}" for c in SCORES) + " FROM phase1_processed", "score_buckets": "SELECT floor(addr_similarity_ratio / 10) * 10 AS bucket, CAST(count(*) AS BIGINT) AS n FROM phase1_processed WHERE addr_similarity_ratio IS NOT NULL GROUP BY 1",
    "label_shares": "SELECT coalesce(l.v, c.v) AS value, CAST(coalesce(n, 0) AS BIGINT) AS n, round(coalesce(n, 0) * 100.0 / sum(coalesce(n, 0)) OVER (), 6) AS pct FROM (SELECT unnest(['alt','base','abstain','both']) AS v) l FULL JOIN (SELECT golden_label AS v, count(*) AS n FROM phase3_slm_labeled GROUP BY 1) c ON l.v = c.v",
    "class_stats": " UNION ALL ".join(f"SELECT golden_label AS label, '{c}' AS \"column\", CAST(count({c}) AS BIGINT) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM phase3_slm_labeled WHERE {c} IS NOT NULL GROUP BY 1" for c in SCORES),
    "score_quantile": "SELECT CAST(0.1 AS DOUBLE) AS q, round(quantile_cont(addr_similarity_ratio, 0.1), 6) AS value FROM phase1_processed",
    "drift": " UNION ALL ".join(f"SELECT '{c}' AS feature, round(a, 6) AS mean_train, round(b, 6) AS mean_live, round(abs(b - a) / s, 6) AS z, abs(b - a) / s > 0.2 AS drifted FROM (SELECT avg({c}) AS a, stddev_samp({c}) AS s FROM phase1_processed), (SELECT avg({c}) AS b FROM phase3_slm_labeled) WHERE s > 0" for c in SCORES),
    "filled_counts": f"SELECT 'base' AS side, round(avg({' + '.join(_SIDE.format(f'norm_base_{x}') for x in ('phone', 'website', 'addr'))}), 6) AS mean_filled FROM golden_dataset_200 UNION ALL SELECT 'alt', round(avg({' + '.join(_SIDE.format(f'norm_conflated_{x}') for x in ('phone', 'website', 'addr'))}), 6) FROM golden_dataset_200",
    "ids_only_in_samples": "SELECT DISTINCT id FROM project_a_samples s WHERE id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM phase1_processed p WHERE p.id = s.id)", "ids_only_in_training": "SELECT DISTINCT id FROM phase3_slm_labeled s WHERE id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM project_a_samples p WHERE p.id = s.id)",
    "domain_offenders": f"SELECT \"column\", value, CAST(count(*) AS BIGINT) AS n FROM (SELECT '3class_testlabels' AS \"column\", lower(trim(\"3class_testlabels\")) AS value FROM golden_dataset_200 WHERE lower(trim(\"3class_testlabels\")) NOT IN ('alt','base','both') UNION ALL SELECT 'attr_web_winner', lower(trim(attr_web_winner)) FROM golden_dataset_200 WHERE lower(trim(attr_web_winner)) NOT IN ('base','alt','both','none')) GROUP BY 1, 2",
    "join_suffixes": "SELECT g.id, g.golden_label AS golden_label_golden, p.golden_label AS golden_label_training FROM golden_dataset_200 g JOIN phase3_slm_labeled p ON g.id = p.id",
    "golden_in_samples": "SELECT id, split FROM golden_dataset_200 WHERE id IN (SELECT id FROM project_a_samples WHERE id IS NOT NULL)", "unlabelled_pairs": "SELECT id FROM phase1_processed p WHERE NOT EXISTS (SELECT 1 FROM phase3_slm_labeled t WHERE t.id = p.id)",
    "golden_flag": "SELECT is_golden, CAST(count(*) AS BIGINT) AS n FROM (SELECT EXISTS (SELECT 1 FROM golden_dataset_200 g WHERE g.id = p.id) AS is_golden FROM phase1_processed p) GROUP BY 1",
    "looked_up_split": "SELECT coalesce(s, 'none') AS split, CAST(count(*) AS BIGINT) AS n FROM phase1_processed p LEFT JOIN (SELECT id, max(split) AS s FROM golden_dataset_200 GROUP BY 1) g ON g.id = p.id GROUP BY 1",
    "all_ids": "SELECT id FROM project_a_samples UNION ALL SELECT id FROM phase3_slm_labeled", "shared_ids": "SELECT id FROM project_a_samples INTERSECT SELECT id FROM phase3_slm_labeled", "ids_without_labels": "SELECT id FROM project_a_samples EXCEPT SELECT id FROM phase3_slm_labeled", "distinct_pairs": "SELECT DISTINCT id, base_id FROM project_a_samples",
    "first_per_base": "SELECT base_id, min(id) AS id FROM project_a_samples WHERE base_id IS NOT NULL GROUP BY 1", "first_pairs": "SELECT DISTINCT id, base_id FROM project_a_samples ORDER BY id, base_id LIMIT 20",
    "hard_cases": "SELECT id, round(addr_similarity_ratio, 6) AS score FROM phase1_processed WHERE addr_similarity_ratio BETWEEN 30 AND 80",
    "nearest_labels": "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, label FROM embeddings), r AS (SELECT a.vec_id, b.vec_id AS k, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS n FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) SELECT vec_id, round(avg(label), 6) AS mean_label, max(CASE WHEN n = 1 THEN k END) AS nearest FROM r WHERE n <= 11 GROUP BY vec_id",
}
