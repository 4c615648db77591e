"""Queries on normal forms, extracts, similarities, features and truth of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import labels as lb
from pairloom.functions import similarity as sim
from pairloom.functions import text as tx
from pairloom.operators import features as fe
from pairloom.operators import truth as tr
from pairloom.sources.tables import table

AS_OF = "2026-01-01"


def _raw(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "project_a_samples")


def _p1(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "phase1_processed")


def _over(source: str, **cells):  # noqa: ANN003, ANN202
    """A query of id and expressions over one table."""
    return lambda spark, folder: table(spark, folder, source).select("id", *[c().alias(k) for k, c in cells.items()])


def _docs(**cells):  # noqa: ANN003, ANN202
    return lambda spark, folder: table(spark, folder, "documents").select("doc_id", *[c().alias(k) for k, c in cells.items()])


def _r(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


def prepared_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The raw columns of phase 1 prepared again."""
    raw = [c for c in _p1(spark, folder).columns if not c.startswith("norm_") and not c.endswith(("_similarity", "_ratio", "_sort"))]
    done = fe.prepare_pairs(_p1(spark, folder).select(*raw))
    scores = ("addr_similarity_ratio", "addr_token_sort", "phone_similarity", "website_similarity")
    return done.select("id", *[c for c in done.columns if c.startswith("norm_")], *[_r(F.col(c)).alias(c) for c in scores])


def features_core(spark: SparkSession, folder: str) -> DataFrame:
    """Features that need no string kernel."""
    f = fe.engineer_features(_p1(spark, folder), AS_OF)
    names = (
        "existence_conf_delta", "match_addr_len", "base_addr_len", "addr_richness_delta", "match_has_phone", "base_has_phone", "match_has_web", "base_has_web", "phone_presence_delta",
        "web_presence_delta", "match_has_brand", "base_has_brand", "match_has_social", "base_has_social", "brand_delta", "social_delta", "addr_similarity", "phone_similarity", "web_similarity",
        "phone_exact_match", "addr_dissimilarity", "conf_x_addr_richness", "phone_exclusive", "web_exclusive",
    )
    return f.select("id", *[_r(F.col(f"feat_{n}")).alias(n) if dict(f.dtypes)[f"feat_{n}"] == "double" else F.col(f"feat_{n}").alias(n) for n in names])


def features_all(spark: SparkSession, folder: str) -> DataFrame:
    """All features."""
    f = fe.engineer_features(_p1(spark, folder), AS_OF, validate_phones=True)
    return f.select("id", *[c for c in f.columns if c.startswith("feat_")])


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Confidence baseline, both detector, quality label and final choice of every pair, counted."""
    f = fe.engineer_features(_p1(spark, folder), AS_OF)
    rows = f.select(lb.highest_confidence().alias("baseline"), lb.both_detector().alias("alike"), lb.quality_label(lb.quality_score("match"), lb.quality_score("base")).alias("quality"))
    rows = rows.withColumn("decision", lb.two_stage(F.col("quality") == 1, F.col("alike")))
    return rows.groupBy("baseline", "alike", "quality", "decision").agg(F.count(F.lit(1)).alias("n"))


def _truth(prefer_alt: bool):  # noqa: ANN202
    def run(spark: SparkSession, folder: str) -> DataFrame:
        done = tr.rule_based_truth(table(spark, folder, "golden_dataset_200"), prefer_alt)
        return done.select("id", *[f"truth_{a}_{x}" for a in lb.TRUTH_ATTRIBUTES for x in ("winner", "value_norm")])

    return run


def truth_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels that follow from rule-based truth, counted."""
    done = tr.rule_based_truth(table(spark, folder, "golden_dataset_200"))
    rows = done.select(lb.truth_4class().alias("four"), lb.truth_4class("none").alias("four_none"), lb.truth_2class().alias("two"), lb.implied_name_winner().alias("name"))
    return rows.groupBy("four", "four_none", "two", "name").agg(F.count(F.lit(1)).alias("n"))


def truth_from_table(spark: SparkSession, folder: str) -> DataFrame:
    """Truth looked up by id in the training split's base side, without fallback."""
    known = table(spark, folder, "phase3_slm_labeled").select("id", F.col("norm_base_phone").alias("phone"), F.col("norm_base_website").alias("web"), F.col("norm_base_addr").alias("address"), tx.primary(F.col("base_categories")).alias("category"))
    done = tr.external_truth(table(spark, folder, "golden_dataset_200"), known, ["id"], "table", allow_fallback=False)
    return done.select("id", "truth_phone_winner", "truth_web_winner", "truth_category_winner", "truth_address_winner")


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """Model answers built from the training winners, wrapped in talk and read again."""
    p3 = table(spark, folder, "phase3_slm_labeled")
    built = tx.answer_json({a: F.col(f"attr_{a}_winner") for a in ("name", "phone", "web", "address", "category")} | {"golden_label": F.col("golden_label"), "reason": F.col("slm_reason")})
    told = p3.select("id", tx.model_answer(F.concat(F.lit("Sure: "), built, F.lit(" - done"))).alias("t"))
    return told.select("id", "t.*")


def prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts of the training pairs by length."""
    fields = {"name": (F.col("base_names"), F.col("names")), "phone": (F.col("base_phones"), F.col("phones")), "web": (F.col("base_websites"), F.col("websites"))}
    return table(spark, folder, "phase3_slm_labeled").select("id", tx.prompt(fields).alias("prompt"))


QUERIES = {
    "prepared_pairs": prepared_pairs, "norm_phone": _over("project_a_samples", phone=lambda: tx.phone_digits(F.col("phones"))), "norm_website": _over("project_a_samples", website=lambda: tx.website(F.col("websites"))),
    "norm_address": _over("phase1_processed", address=lambda: tx.address_text(F.col("addresses")), base=lambda: tx.address_text(F.col("base_addresses"))),
    "norm_freeform": _over("project_a_samples", freeform=lambda: tx.address_freeform(F.col("addresses"))), "primary_names": _over("project_a_samples", name=lambda: tx.primary(F.col("names")), category=lambda: tx.primary(F.col("categories"))),
    "first_url": _over("project_a_samples", url=lambda: tx.first_url(F.col("websites"))), "extract_url": _over("project_a_samples", url=lambda: tx.with_scheme(tx.extract_url(F.col("websites")))),
    "sources_info": _over("project_a_samples", n=lambda: tx.sources_info(F.col("sources"))["n"], datasets=lambda: F.array_join(tx.sources_info(F.col("sources"))["datasets"], ",")),
    "content_flags": _over("project_a_samples", loose=lambda: tx.has_content(F.col("socials")), strict=lambda: tx.has_content(F.col("socials"), True)),
    "locality_postcode": _over("project_a_samples", locality=lambda: tx.locality_and_postcode(F.col("addresses"))["locality"], postcode=lambda: tx.locality_and_postcode(F.col("addresses"))["postcode"]),
    "address_parts": _over("phase1_processed", num=lambda: tx.address_parts(F.col("norm_conflated_addr"))["num"], unit=lambda: tx.address_parts(F.col("norm_conflated_addr"))["unit"], street=lambda: tx.address_parts(F.col("norm_conflated_addr"))["street"]),
    "address_score": _over("phase1_processed", score=lambda: tx.address_score(F.col("norm_conflated_addr"))), "address_filled": _over("phase1_processed", parts=lambda: tx.address_completeness(F.col("addresses"))),
    "phone_regions": _over("phase1_processed", region=lambda: tx.region_of(F.col("norm_conflated_addr")), e164=lambda: tx.phone_e164(F.col("norm_conflated_phone"), F.coalesce(tx.region_of(F.col("norm_conflated_addr")), F.lit("US")))),
    "phone_winners": _over("golden_dataset_200", winner=lambda: tr.phone_winner(F.col("norm_base_phone"), F.col("norm_conflated_phone"), F.lit("US"), F.lit("US"))["winner"]),
    "address_winners": _over("golden_dataset_200", winner=lambda: tr.address_winner(F.col("base_addresses"), F.col("addresses"))),
    "name_words": _over("project_a_samples", words=lambda: F.array_join(tx.significant_words(tx.primary(F.col("names"))), " ")), "cache_keys": _over("project_a_samples", key=lambda: tx.cache_key(F.lit("website"), F.coalesce("websites", F.lit("")))),
    "first_phone": _docs(phone=lambda: tx.first_phone(F.col("text"))), "first_street": _docs(street=lambda: tx.first_street(F.col("text"))),
    "html_text": _docs(words=lambda: tx.html_text(F.concat(F.lit("<p>"), F.col("text"), F.lit("</p><script>x=1</script>")))),
    "street_words": _docs(text=lambda: F.md5(tx.expand_street_words(F.col("text")))), "model_answers": answers, "prompts": prompts,
    "sim_ratio": _over("phase1_processed", addr=lambda: _r(sim.guarded(sim.ratio, F.col("norm_conflated_addr"), F.col("norm_base_addr"))), web=lambda: _r(sim.guarded(sim.ratio, F.col("norm_conflated_website"), F.col("norm_base_website")))),
    "sim_token_sort": _over("phase1_processed", addr=lambda: _r(sim.guarded(sim.token_sort_ratio, F.col("norm_conflated_addr"), F.col("norm_base_addr")))),
    "sim_jaccard": _over("phase1_processed", addr=lambda: _r(sim.jaccard(F.col("norm_conflated_addr"), F.col("norm_base_addr")))), "sim_jaro_winkler": _over("phase1_processed", addr=lambda: _r(sim.jaro_winkler(F.col("norm_conflated_addr"), F.col("norm_base_addr")))),
    "sim_token_set": _over("phase1_processed", addr=lambda: _r(sim.token_set_ratio(F.col("norm_conflated_addr"), F.col("norm_base_addr")))), "sim_partial": _over("phase1_processed", addr=lambda: _r(sim.partial_ratio(F.col("norm_conflated_addr"), F.col("norm_base_addr")))),
    "fuzzy_match": _over("phase1_processed", match=lambda: sim.fuzzy_match(F.col("norm_conflated_addr"), F.col("norm_base_addr"))), "address_component_score": _over("phase1_processed", score=lambda: _r(sim.address_component_score(F.col("norm_conflated_addr"), F.col("norm_base_addr")))),
    "value_similarity": _over("phase1_processed", phone=lambda: sim.value_similarity("phone", F.col("norm_conflated_phone"), F.col("norm_base_phone")), web=lambda: sim.value_similarity("web", F.col("norm_conflated_website"), F.col("norm_base_website")), address=lambda: _r(sim.value_similarity("address", F.col("norm_conflated_addr"), F.col("norm_base_addr")))),
    "fuzzy_scores": lambda s, d: fe.add_fuzzy_scores(table(s, d, "golden_dataset_200")).select("id", *[_r(F.col(c)).alias(c) for c in ("fuzzy_score_name", "fuzzy_score_phone", "fuzzy_score_web", "fuzzy_score_address", "fuzzy_score_category", "total_similarity", "total_similarity_sum")]),
    "legacy_scores": lambda s, d: fe.legacy_scores(table(s, d, "golden_dataset_200")).select("id", _r(F.col("match_score")).alias("match_score"), "pred_label"),
    "features_core": features_core, "features_all": features_all, "decisions": decisions, "truth_phone_base_preferred": lambda s, d: tr.rule_based_truth(table(s, d, "golden_dataset_200"), False).select("id", F.col("truth_phone_winner").alias("winner")), "truth_base_preferred": _truth(False), "truth_alt_preferred": _truth(True), "truth_labels": truth_labels, "truth_from_table": truth_from_table,
}

_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_DIGITS = "regexp_replace(coalesce({0}, ''), '[^0-9]', '', 'g')"
_LOWER = "regexp_replace(lower(coalesce({0}, '')), '^\\s+|\\s+$', '', 'g')"
_SITE = "regexp_replace(regexp_replace(regexp_replace(" + _LOWER + ", '^https?://', ''), '^www\\.', ''), '^/+|/+$', '', 'g')"
_OBJ = "(CASE WHEN json_valid({0}) AND json_type({0}) = 'OBJECT' THEN coalesce(json_extract_string({0}, '$.{1}'), '') ELSE '' END)"
_FIRST = "(CASE WHEN " + _STRIP.format("coalesce({0}, '')") + " LIKE '[%' THEN coalesce(CASE WHEN json_valid({0}) THEN " + _STRIP.format("json_extract_string({0}, '$[0]')") + " END, " + _STRIP.format("coalesce({0}, '')") + ") ELSE " + _STRIP.format("coalesce({0}, '')") + " END)"
_LOC = "lower(trim(coalesce(CASE WHEN json_valid(addresses) THEN json_extract_string(addresses, '$[0].{0}') END, CASE WHEN json_valid(addresses) THEN json_extract_string(addresses, '$.{0}') END, '')))"
_HAS = "CAST(({0}) AS INTEGER)"
_TOKENS = "list_distinct(list_filter(string_split_regex(lower(coalesce({0}, '')), '\\s+'), lambda x: x <> ''))"
_NO_REAL = "CASE WHEN {b} <> '' AND {a} <> '' AND {b} = {a} THEN 'both' WHEN {b} <> '' THEN 'base' ELSE 'alt' END"

ORACLES = {
    "prepared_pairs": "SELECT id, norm_conflated_addr, norm_conflated_phone, norm_conflated_website, norm_base_addr, norm_base_phone, norm_base_website, round(addr_similarity_ratio, 6) AS addr_similarity_ratio, round(addr_token_sort, 6) AS addr_token_sort, round(phone_similarity, 6) AS phone_similarity, round(website_similarity, 6) AS website_similarity FROM phase1_processed",
    "norm_phone": f"SELECT id, {_DIGITS.format('phones')} AS phone FROM project_a_samples", "norm_website": f"SELECT id, {_SITE.format('websites')} AS website FROM project_a_samples",
    "norm_address": "SELECT id, norm_conflated_addr AS address, norm_base_addr AS base FROM phase1_processed", "primary_names": f"SELECT id, {_OBJ.format('names', 'primary')} AS name, {_OBJ.format('categories', 'primary')} AS category FROM project_a_samples",
    "first_url": f"SELECT id, {_FIRST.format('websites')} AS url FROM project_a_samples",
    "sources_info": "SELECT id, CAST(CASE WHEN json_type(sources) = 'ARRAY' THEN json_array_length(sources) ELSE 0 END AS INTEGER) AS n, coalesce(CASE WHEN json_type(sources) = 'ARRAY' THEN array_to_string(list_sort(list_distinct(list_filter(list_transform(CAST(json_extract_string(sources, '$[*].dataset') AS VARCHAR[]), lambda x: lower(x)), lambda x: x IS NOT NULL))), ',') END, '') AS datasets FROM (SELECT id, CASE WHEN json_valid(sources) THEN sources ELSE '{}' END AS sources FROM project_a_samples)",
    "content_flags": "SELECT id, coalesce(length(socials) > 0, false) AS loose, coalesce(lower(trim(socials)) NOT IN ('', 'nan', 'none', '{}', '[]', 'null'), false) AS strict FROM project_a_samples",
    "locality_postcode": f"SELECT id, {_LOC.format('locality')} AS locality, {_LOC.format('postcode')} AS postcode FROM project_a_samples",
    "cache_keys": "SELECT id, md5('website:' || coalesce(websites, '')) AS key FROM project_a_samples",
    "model_answers": "SELECT id, " + ", ".join(f"CASE WHEN lower(trim(attr_{a}_winner)) IN ('base','alt','both','none') THEN lower(trim(attr_{a}_winner)) ELSE 'none' END AS attr_{a}_winner" for a in ("name", "phone", "web", "address", "category")) + ", CASE WHEN lower(trim(golden_label)) IN ('base','alt') THEN lower(trim(golden_label)) ELSE 'abstain' END AS golden_label, coalesce(slm_reason, '') AS slm_reason FROM phase3_slm_labeled",
    "sim_ratio": "SELECT id, round(addr_similarity_ratio, 6) AS addr, round(website_similarity, 6) AS web FROM phase1_processed", "sim_token_sort": "SELECT id, round(addr_token_sort, 6) AS addr FROM phase1_processed",
    "sim_jaccard": f"SELECT id, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE) END, 6) AS addr FROM (SELECT id, {_TOKENS.format('norm_conflated_addr')} AS x, {_TOKENS.format('norm_base_addr')} AS y FROM phase1_processed)",
    "fuzzy_match": "SELECT id, CASE WHEN coalesce(norm_conflated_addr, '') = '' OR coalesce(norm_base_addr, '') = '' THEN coalesce(norm_conflated_addr, '') = coalesce(norm_base_addr, '') ELSE greatest(addr_similarity_ratio, addr_token_sort) >= 85 END AS match FROM phase1_processed",
    "value_similarity": "SELECT id, " + ", ".join(f"CASE WHEN coalesce({a}, '') = coalesce({b}, '') THEN CAST(100.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS {n}" for n, a, b in (("phone", "norm_conflated_phone", "norm_base_phone"), ("web", "norm_conflated_website", "norm_base_website"))) + ", round(CASE WHEN coalesce(norm_conflated_addr, '') = '' AND coalesce(norm_base_addr, '') = '' THEN 100.0 ELSE addr_similarity_ratio END, 6) AS address FROM phase1_processed",
    "truth_phone_base_preferred": f"SELECT id, {_NO_REAL.format(a=_DIGITS.format('norm_conflated_phone'), b=_DIGITS.format('norm_base_phone'))} AS winner FROM golden_dataset_200",
    "features_core": f"""SELECT id, round(confidence - base_confidence, 6) AS existence_conf_delta, CAST(ml AS INTEGER) AS match_addr_len, CAST(bl AS INTEGER) AS base_addr_len, CAST(ml - bl AS INTEGER) AS addr_richness_delta,
      mp AS match_has_phone, bp AS base_has_phone, mw AS match_has_web, bw AS base_has_web, mp - bp AS phone_presence_delta, mw - bw AS web_presence_delta, mb AS match_has_brand, bb AS base_has_brand, ms AS match_has_social, bs AS base_has_social,
      mb - bb AS brand_delta, ms - bs AS social_delta, round(addr_similarity_ratio / 100, 6) AS addr_similarity, round(coalesce(phone_similarity / 100, 0.0), 6) AS phone_similarity, round(coalesce(website_similarity / 100, 0.0), 6) AS web_similarity,
      {_HAS.format("p <> '' AND p = q")} AS phone_exact_match, round(1.0 - addr_similarity_ratio / 100, 6) AS addr_dissimilarity, round((confidence - base_confidence) * greatest(ml - bl, 0), 6) AS conf_x_addr_richness,
      {_HAS.format("mp = 1 AND bp = 0")} AS phone_exclusive, {_HAS.format("mw = 1 AND bw = 0")} AS web_exclusive
      FROM (SELECT *, length(coalesce(norm_conflated_addr, '')) AS ml, length(coalesce(norm_base_addr, '')) AS bl, {_DIGITS.format('norm_conflated_phone')} AS p, {_DIGITS.format('norm_base_phone')} AS q, {_HAS.format(_DIGITS.format('norm_conflated_phone') + " <> ''")} AS mp, {_HAS.format(_DIGITS.format('norm_base_phone') + " <> ''")} AS bp,
        {_HAS.format(_SITE.format('norm_conflated_website') + " <> ''")} AS mw, {_HAS.format(_SITE.format('norm_base_website') + " <> ''")} AS bw, {_HAS.format('coalesce(length(brand) > 0, false)')} AS mb, {_HAS.format('coalesce(length(base_brand) > 0, false)')} AS bb,
        {_HAS.format('coalesce(length(socials) > 0, false)')} AS ms, {_HAS.format('coalesce(length(base_socials) > 0, false)')} AS bs FROM phase1_processed)""",
}
