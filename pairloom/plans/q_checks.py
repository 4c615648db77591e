"""Queries on the whole pipeline and its reports, and SQL for operators whose other queries are in the modules beside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import labels as lb
from pairloom.functions import text as tx
from pairloom.operators import joins as jn
from pairloom.operators import models as mo
from pairloom.operators import pipeline as pl
from pairloom.operators import sampling as sa
from pairloom.operators import truth as tr
from pairloom.operators.features import MODEL_FEATURES, engineer_features
from pairloom.plans import sqltext as q
from pairloom.schemas import ATTRIBUTES, REFINER_CLASSES, THREE_CLASSES
from pairloom.session import cut_lineage
from pairloom.sources.tables import table

AS_OF = "2026-01-01"
SCORES = ["addr_similarity_ratio", "addr_token_sort", "phone_similarity", "website_similarity"]
GOLDEN, TRAINING, PAIRS = "golden_dataset_200", "phase3_slm_labeled", "phase1_processed"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(c), 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def pipeline_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Baseline, model and final selection of every pair; the model is the refiner trained on the training split."""
    training = engineer_features(table(spark, folder, TRAINING), AS_OF)
    model = mo.fit(training, list(MODEL_FEATURES), lb.label_3class(), REFINER_CLASSES, mo.forest(trees=200, depth=12), weights={"alt": 1.5, "base": 1.5, "both": 1.0})
    done = pl.run_pipeline(table(spark, folder, PAIRS), AS_OF, model)
    return done.select("id", "baseline_selection", "model_3class_prediction", "final_prediction")


def pipeline_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The pipeline's strategies without a model against golden."""
    return _rounded(pl.pipeline_report(pl.run_pipeline(table(spark, folder, PAIRS), AS_OF), table(spark, folder, GOLDEN)))


def _by_rule(spark: SparkSession, folder: str, prefer_alt: bool = True) -> DataFrame:
    """Rule-based truth of golden, written before a report reads it."""
    return cut_lineage(tr.rule_based_truth(table(spark, folder, GOLDEN), prefer_alt))


def verify_report(spark: SparkSession, folder: str) -> DataFrame:
    """The report on rule-based truth of golden."""
    return _rounded(pl.verify_report(_by_rule(spark, folder)))


def verify_phone(spark: SparkSession, folder: str) -> DataFrame:
    """The report's lines on phones, with base preferred, which SQL can follow."""
    return verify_base(spark, folder).filter((F.col("attribute") == "phone") & F.col("section").isin("match", "place", "winner"))


def verify_base(spark: SparkSession, folder: str) -> DataFrame:
    """The report on rule-based truth that prefers base."""
    return _rounded(pl.verify_report(_by_rule(spark, folder, False)))


def threshold_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy of the address similarity as a score against the training labels."""
    return _rounded(pl.threshold_accuracy(table(spark, folder, PAIRS), table(spark, folder, TRAINING), "addr_similarity_ratio", 70.0))


def best_feature_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    """The threshold of each score that tells best whether the address winner is base or both."""
    w = lb.winner_strict(F.col("attr_address_winner"))
    rows = table(spark, folder, TRAINING).select(F.when(w.isin("base", "both"), 1).otherwise(0).alias("y"), *SCORES)
    return _rounded(pl.best_feature_thresholds(rows, "y", SCORES))


def winners_by_rule(spark: SparkSession, folder: str) -> DataFrame:
    """Winners of websites that answer, of names and categories by equality, and margins turned into labels."""
    g = table(spark, folder, GOLDEN)
    there = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    return g.select(
        "id", tr.web_winner(there("norm_base_website"), there("norm_conflated_website")).alias("web"), tr.equality_winner(tx.primary(F.col("base_names")), tx.primary(F.col("names"))).alias("name"),
        lb.golden_label_by_margin(F.round(F.col("base_confidence") * 4).cast("int"), F.round(F.col("confidence") * 4).cast("int")).alias("label"),
        tr.all_or_any([f"attr_{a}_winner" for a in ATTRIBUTES], "base", True).alias("all_base"), tr.all_or_any([f"attr_{a}_winner" for a in ATTRIBUTES], "alt", False).alias("any_alt"),
    )


def first_truth(spark: SparkSession, folder: str) -> DataFrame:
    """Phone truth from a table with repeated keys, of which the first whole row counts."""
    known = table(spark, folder, PAIRS).select("base_id", F.col("norm_base_phone").alias("phone"), F.col("norm_base_website").alias("web"), F.lit("").alias("address"), F.lit("").alias("category"))
    done = tr.external_truth(table(spark, folder, GOLDEN), known, ["base_id"], "table", allow_fallback=False)
    return done.select("id", F.col("truth_phone_winner").alias("winner"), F.col("truth_phone_value_norm").alias("value"))


def stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each label that fall to training and to test."""
    rows = table(spark, folder, TRAINING).withColumn("label", lb.label_4class())
    return sa.stratified_split(rows, "id", "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_test").cast("long")).alias("n_test"))


def split_by_last(spark: SparkSession, folder: str) -> DataFrame:
    """A value looked up by key of which the row of greatest similarity counts."""
    return jn.looked_up(table(spark, folder, GOLDEN).select("id"), table(spark, folder, PAIRS).filter("base_id IS NOT NULL"), "id", "base_id", "base_id", "none", order="confidence")


def negatives_count(spark: SparkSession, folder: str) -> DataFrame:
    """How many random negatives come out, and how many of them are sound."""
    found = sa.random_negatives(table(spark, folder, "project_a_samples"))
    return found.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id", "base_id").alias("n_distinct"), F.sum(F.when(F.col("id") != F.col("base_id"), 1).otherwise(0)).cast("long").alias("n_apart"))


QUERIES = {
    "pipeline_decisions": pipeline_decisions,
    "pipeline_metrics": pipeline_metrics,
    "verify_report": verify_report,
    "verify_base": verify_base,
    "verify_phone": verify_phone,
    "verify_disagreements": lambda s, d: pl.disagreements(_by_rule(s, d, False)),
    "threshold_accuracy": threshold_accuracy,
    "best_feature_thresholds": best_feature_thresholds,
    "winners_by_rule": winners_by_rule,
    "first_truth": first_truth,
    "stratified_split": stratified_split,
    "value_of_last": split_by_last,
    "negatives_count": negatives_count,
}

#: Word characters of Unicode, as a class of RE2.
_W = "\\p{L}\\p{M}\\p{N}\\p{Pc}"
_SPACE = "[\\s\\x0b\\x85\\p{Z}]"
_DIGITS = "regexp_replace(coalesce({0}, ''), '[^0-9]', '', 'g')"


def _bare(text: str) -> str:
    """Without white space of any kind at the ends."""
    return f"regexp_replace({text}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _shown(c: str) -> str:
    return f"coalesce(nullif({_bare(c)}, ''), '(empty)')"


def _expanded(text: str) -> str:
    """Short street words written out; each twice, as neighbours share the space between them."""
    out = f"coalesce(lower({text}), '')"
    for short, full in tx.STREET_WORDS:
        for _ in range(2):
            out = f"regexp_replace({out}, '(^|[^{_W}]){short}($|[^{_W}])', '\\1{full}\\2', 'g')"
    return out


_REGION = (
    "CASE "
    + " ".join(f"WHEN {' OR '.join(f'contains(t, {form!r})' for form in forms)} THEN '{region}'" for region, forms in tx.REGIONS.items())
    + f" WHEN regexp_matches(t, '(^|[^{_W}])({'|'.join(tx.STATES)})($|[^{_W}])') THEN 'US' END"
)
_NATIONAL = "CASE WHEN r IN ('US','CA') THEN regexp_extract(d, '^1?([2-9][0-9]{2}[2-9][0-9]{6})$', 1) ELSE regexp_extract(d, '^0?([1-9][0-9]{6,11})$', 1) END"
_CODE = "CASE WHEN r IN ('US','CA') THEN '1' WHEN r = 'GB' THEN '44' END"
_E164 = f"coalesce(CASE WHEN p LIKE '+%' AND regexp_matches(d, '^[1-9][0-9]{{7,14}}$') THEN '+' || d END, CASE WHEN {_NATIONAL} <> '' THEN '+' || {_CODE} || {_NATIONAL} END)"


def _valid(c: str) -> str:
    """Whether a phone column is valid, read in the US."""
    return f"(regexp_matches({_DIGITS.format(c)}, '^1?[2-9][0-9]{{2}}[2-9][0-9]{{6}}$') OR (trim(coalesce({c}, '')) LIKE '+%' AND regexp_matches({_DIGITS.format(c)}, '^[1-9][0-9]{{7,14}}$')))"


_SEEDED = "CAST('0x' || substr(md5({0} || chr(1) || '{1}'), 1, 15) AS BIGINT)"
_UNIT = "\\b(ste|suite|apt|unit|#)\\s*([\\w-]+)"
_WRAPPING = "[\\s\\[\\]\"''{}]"
_FOUND = "regexp_replace(regexp_extract(b, 'https?://[^\\s\\]\"''}>,]+', 0), '[.,;:)]+$', '')"
_LINK = f"CASE WHEN {_FOUND} <> '' THEN {_FOUND} ELSE b END"
_ONE_SPACE = f"regexp_replace(text, '{_SPACE}+', ' ', 'g')"
_NAME = "(CASE WHEN json_valid(names) AND json_type(names) = 'OBJECT' THEN coalesce(json_extract_string(names, '$.primary'), '') ELSE '' END)"
_PLACE = "CASE WHEN json_valid(addresses) THEN coalesce(json_extract_string(addresses, '$[0].{0}'), json_extract_string(addresses, '$.{0}')) END"
_FREE = "CASE WHEN json_valid(addresses) AND json_type(addresses) = 'OBJECT' THEN trim(coalesce(json_extract_string(addresses, '$.freeform'), '')) WHEN json_valid(addresses) AND json_type(addresses) = 'ARRAY' AND json_type(addresses, '$[0]') = 'OBJECT' THEN trim(coalesce(json_extract_string(addresses, '$[0].freeform'), '')) ELSE addresses END"
_P = {s: _DIGITS.format(f"norm_{s}_phone") for s in ("base", "conflated")}
_PREFERS_BASE = f"CASE WHEN {_P['base']} <> '' AND {_P['base']} = {_P['conflated']} THEN 'both' WHEN {_P['base']} <> '' THEN 'base' ELSE 'alt' END"


def _side(prefix: str) -> str:
    norm, plain = ("norm_base_phone", "base_phones") if prefix else ("norm_conflated_phone", "phones")
    return _DIGITS.format(f"coalesce(nullif({norm}, ''), nullif({plain}, ''), '')")


_VERIFY = f"""(SELECT b, a, CASE WHEN b <> '' THEN b ELSE a END AS t, CASE WHEN {q.strict('attr_phone_winner')} = 'alt' THEN a ELSE b END AS g,
  CASE WHEN b <> '' AND b = a THEN 'both' WHEN b <> '' THEN 'base' ELSE 'alt' END AS tw, {q.plain('attr_phone_winner')} AS gw
  FROM (SELECT *, {_side('base')} AS b, {_side('')} AS a FROM golden_dataset_200))"""


def _line(section: str, measure: str, value: str) -> str:
    return f"SELECT '{section}' AS section, 'phone' AS attribute, '{measure}' AS measure, round({value}, 6) AS value FROM {_VERIFY}"


def _share(condition: str) -> str:
    return f"avg(CASE WHEN {condition} THEN 1.0 ELSE 0.0 END)"


def _towns(prefix: str) -> str:
    """(name, town, id): the smallest id of a name in each town of one side."""
    place = f"CASE WHEN json_valid({prefix}addresses) THEN coalesce(json_extract_string({prefix}addresses, '$[0].locality'), json_extract_string({prefix}addresses, '$.locality')) END"
    name = f"CASE WHEN json_valid({prefix}names) AND json_type({prefix}names) = 'OBJECT' THEN coalesce(json_extract_string({prefix}names, '$.primary'), '') ELSE '' END"
    return f"(SELECT {name} AS name, lower(trim(coalesce({place}, ''))) AS town, min({prefix}id) AS id FROM project_a_samples WHERE {prefix}id IS NOT NULL AND length({name}) >= 4 GROUP BY 1, 2)"


_KINDS = "street|st|avenue|ave|blvd|road|rd|drive|dr|lane|ln|court|ct"
_UNICODE = "\\p{L}\\p{M}\\p{N}\\p{Pc}\\x{200c}\\x{200d}"
_WHITE = "\\s\\x0b\\x85\\p{Z}"

_CELL = "least(floor(({0} - lo) / (CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END) * 100), 99)"
_YES = f"(CASE WHEN {q.strict('attr_address_winner')} IN ('base','both') THEN 1 ELSE 0 END)"


def _best(c: str) -> str:
    """The best of a hundred steps of one feature, by brute force over rows and steps."""
    return f"""SELECT '{c}' AS feature, round(lo + k * (hi - lo) / 100, 6) AS threshold, round(accuracy, 6) AS accuracy FROM (
      SELECT k, any_value(lo) AS lo, any_value(hi) AS hi, avg(CASE WHEN (cell >= k) = (y = 1) THEN 1.0 ELSE 0.0 END) AS accuracy
      FROM (SELECT {_CELL.format(c)} AS cell, y, lo, hi FROM (SELECT {c}, {_YES} AS y FROM {TRAINING} WHERE {c} IS NOT NULL), (SELECT min({c}) AS lo, max({c}) AS hi FROM {TRAINING})), (SELECT unnest(range(100)) AS k) GROUP BY k)
      QUALIFY row_number() OVER (ORDER BY round(accuracy, 9) DESC, k) = 1"""


ORACLES = {
    "norm_freeform": f"SELECT id, {_expanded(_FREE)} AS freeform FROM project_a_samples",
    "street_words": f"SELECT doc_id, md5({_expanded('text')}) AS text FROM documents",
    "extract_url": f"SELECT id, CASE WHEN u = '' OR regexp_matches(u, '^https?://') THEN u ELSE 'https://' || u END AS url FROM (SELECT id, {_bare(_LINK)} AS u FROM (SELECT id, regexp_replace(coalesce(websites, ''), '^{_WRAPPING}+|{_WRAPPING}+$', '', 'g') AS b FROM project_a_samples))",
    "address_parts": f"""SELECT id, num, CASE WHEN told THEN trim(regexp_replace(rest, '{_UNIT}', '', 'g')) ELSE rest END AS street, CASE WHEN told THEN regexp_extract(rest, '{_UNIT}', 1) || ' ' || regexp_extract(rest, '{_UNIT}', 2) ELSE '' END AS unit
      FROM (SELECT *, regexp_extract(rest, '{_UNIT}', 0) <> '' AS told FROM (SELECT id, regexp_extract(t, '^([0-9]+)\\s+(.*)', 1) AS num, CASE WHEN regexp_matches(t, '^[0-9]+\\s+') THEN regexp_extract(t, '^([0-9]+)\\s+(.*)', 2) ELSE t END AS rest FROM (SELECT id, coalesce(norm_conflated_addr, '') AS t FROM phase1_processed)))""",
    "address_score": "SELECT id, CAST(CASE WHEN length(trim(t)) < 5 THEN 0 ELSE CAST(regexp_matches(t, '[0-9]') AS INT) + CAST(regexp_matches(t, '(?i)\\b(st|street|ave|avenu|road|rd|blvd|dr)\\b') AS INT) + CAST(regexp_matches(t, '\\b[A-Z]{2}\\b|\\b[0-9]{5}\\b') AS INT) END AS INTEGER) AS score FROM (SELECT id, coalesce(norm_conflated_addr, '') AS t FROM phase1_processed)",
    "phone_regions": f"SELECT id, region, {_E164} AS e164 FROM (SELECT *, coalesce(region, 'US') AS r FROM (SELECT id, {_REGION} AS region, trim(coalesce(norm_conflated_phone, '')) AS p, {_DIGITS.format('norm_conflated_phone')} AS d FROM (SELECT *, upper(coalesce(norm_conflated_addr, '')) AS t FROM phase1_processed)))",
    "phone_winners": f"SELECT id, CASE WHEN b AND a THEN 'both' WHEN b THEN 'base' WHEN a THEN 'alt' ELSE 'none' END AS winner FROM (SELECT id, {_valid('norm_base_phone')} AS b, {_valid('norm_conflated_phone')} AS a FROM golden_dataset_200)",
    "name_words": f"SELECT id, array_to_string(list_filter(regexp_split_to_array(regexp_replace({_NAME}, '[^\\p{{L}}\\p{{N}}_\\s\\x85\\p{{Z}}]', ' ', 'g'), '{_SPACE}+'), lambda w: length(w) > 2), ' ') AS words FROM project_a_samples",
    "first_phone": "SELECT doc_id, coalesce(trim(regexp_extract(text, '((\\+?1?[-.\\s]?)?\\(?[0-9]{3}\\)?[-.\\s]?[0-9]{3}[-.\\s]?[0-9]{4})($|[^\\p{L}\\p{N}_])', 1)), '') AS phone FROM documents",
    "html_text": f"SELECT doc_id, {_bare(_ONE_SPACE)} AS words FROM documents",
    "prompts": "SELECT id, 'Decide for each attribute whether base, alt, both or none is right. Answer with one JSON object.'" + "".join(f" || chr(10) || '{n}: base=' || {_shown('base_' + c)} || ' | alt=' || {_shown(c)}" for n, c in (("name", "names"), ("phone", "phones"), ("web", "websites"))) + " AS prompt FROM phase3_slm_labeled",
    "columns_with_match": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n FROM golden_dataset_200 WHERE \"{c}\" = 'match' HAVING count(*) > 0" for c in (*(f"attr_{a}_winner" for a in ATTRIBUTES), "golden_label", "3class_testlabels", "2class_testlabels", "4class_testlabels", "split")),
    "hard_negatives": f"SELECT name, id, base_id FROM (SELECT a.name, a.id, b.id AS base_id, row_number() OVER (PARTITION BY a.name ORDER BY a.id, b.id) AS k FROM {_towns('')} a JOIN {_towns('base_')} b ON a.name = b.name AND a.town <> b.town AND a.id <> b.id) WHERE k = 1 ORDER BY {_SEEDED.format('name', 42)}, name LIMIT 1000",
    "first_street": f"SELECT doc_id, {_bare(f'coalesce(regexp_extract(text, {chr(39)}(?i)(\\p{{Nd}}+[{_WHITE}]+[{_UNICODE}{_WHITE}]+(?:{_KINDS})(?:[{_WHITE},][{_UNICODE}{_WHITE},]*)?)(?:$|[^{_UNICODE}{_WHITE},]){chr(39)}, 1), {chr(39) * 2})')} AS street FROM documents",
    "hash_split": f"SELECT id, {_SEEDED.format('coalesce(id, chr(0))', 42)} % 10000 < 2000 AS is_test FROM phase3_slm_labeled",
    "sampled_pairs": f"SELECT DISTINCT id, base_id FROM project_a_samples QUALIFY dense_rank() OVER (ORDER BY {_SEEDED.format('id', 42)}, id) <= 100",
    "stratified_split": f"SELECT label, count(*) AS n, CAST(floor(count(*) * 0.2 + 0.5) AS BIGINT) AS n_test FROM (SELECT {q.FOUR} AS label FROM {q.winners('phase3_slm_labeled', '', 'lenient')}) GROUP BY label",
    "negatives_count": "SELECT CAST(5000 AS BIGINT) AS n, CAST(5000 AS BIGINT) AS n_distinct, CAST(5000 AS BIGINT) AS n_apart",
    "threshold_accuracy": "SELECT CAST(70.0 AS DOUBLE) AS threshold, count(*) AS n, round(avg(CASE WHEN coalesce(addr_similarity_ratio >= 70, false) = (golden_label = 'alt') THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM phase1_processed JOIN (SELECT DISTINCT id, golden_label FROM phase3_slm_labeled WHERE golden_label IN ('base','alt')) USING (id)",
    "best_feature_thresholds": " UNION ALL ".join(f"({_best(c)})" for c in SCORES),
    "winners_by_rule": f"""SELECT id, CASE WHEN b AND a THEN 'both' WHEN b THEN 'base' WHEN a THEN 'alt' ELSE 'none' END AS web, CASE WHEN {q.plain('bn')} = {q.plain('an')} THEN 'both' END AS name,
      CASE WHEN x - y >= 2 THEN 'base' WHEN y - x >= 2 THEN 'alt' ELSE 'abstain' END AS label, {' AND '.join(f"{q.plain(f'attr_{a}_winner')} = 'base'" for a in ATTRIBUTES)} AS all_base, {' OR '.join(f"{q.plain(f'attr_{a}_winner')} = 'alt'" for a in ATTRIBUTES)} AS any_alt
      FROM (SELECT *, coalesce(norm_base_website <> '', false) AS b, coalesce(norm_conflated_website <> '', false) AS a, {_NAME} AS an, {_NAME.replace('names', 'base_names')} AS bn,
        CAST(round(base_confidence * 4) AS INT) AS x, CAST(round(confidence * 4) AS INT) AS y FROM golden_dataset_200)""",
    "first_truth": f"""SELECT id, CASE WHEN r = '' THEN 'no_data' WHEN r = b AND r = a THEN 'both' WHEN r = b THEN 'base' WHEN r = a THEN 'alt' ELSE 'real' END AS winner, r AS value
      FROM (SELECT g.id, {_DIGITS.format('k.phone')} AS r, {_side('base')} AS b, {_side('')} AS a FROM golden_dataset_200 g
        LEFT JOIN (SELECT base_id, norm_base_phone AS phone FROM phase1_processed QUALIFY row_number() OVER (PARTITION BY base_id ORDER BY norm_base_phone NULLS FIRST, norm_base_website NULLS FIRST) = 1) k ON k.base_id = g.base_id)""",
    "value_of_last": "SELECT g.id, coalesce(v, 'none') AS base_id FROM golden_dataset_200 g LEFT JOIN (SELECT id, arg_max(base_id, confidence) AS v FROM phase1_processed WHERE base_id IS NOT NULL GROUP BY id) k ON k.id = g.id",
    "verify_phone": " UNION ALL ".join([_line("match", "share", _share("t = g")), *[_line("place", m, _share(c)) for m, c in (("base", "t = b AND t <> a"), ("alt", "t = a AND t <> b"), ("both", "t = b AND t = a"), ("neither", "t <> b AND t <> a"))], *[_line("winner", m, f"CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS DOUBLE)") for m, c in (("agree", "tw = gw"), ("disagree", "tw <> gw"), ("suggested", "false"))]]),
}
