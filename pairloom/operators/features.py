"""Pair preparation, similarity scores and the numeric features of a pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions import similarity as sim
from pairloom.functions import text as tx
from pairloom.schemas import STAGES, missing_columns

SIDES = {"match": "", "base": "base_"}

#: The features that models are given: all but three that repeat others.
MODEL_FEATURES = (
    "feat_existence_conf_delta", "feat_match_exists_score", "feat_base_exists_score", "feat_addr_richness_delta", "feat_match_has_phone", "feat_base_has_phone",
    "feat_match_has_web", "feat_base_has_web", "feat_phone_presence_delta", "feat_web_presence_delta", "feat_match_has_brand", "feat_base_has_brand",
    "feat_match_has_social", "feat_base_has_social", "feat_brand_delta", "feat_social_delta", "feat_match_web_valid", "feat_base_web_valid", "feat_web_valid_delta",
    "feat_match_phone_valid", "feat_base_phone_valid", "feat_phone_valid_delta", "feat_name_similarity", "feat_addr_similarity", "feat_phone_similarity",
    "feat_web_similarity", "feat_phone_exact_match", "feat_category_similarity", "feat_category_exact_match", "feat_is_msft_match", "feat_is_meta_match",
    "feat_src_count_delta", "feat_match_recency_days", "feat_base_recency_days", "feat_recency_delta", "feat_match_completeness", "feat_base_completeness",
    "feat_completeness_delta", "feat_valid_count_delta", "feat_name_addr_sim_product", "feat_avg_similarity", "feat_adds_new_info", "feat_addr_dissimilarity",
    "feat_conf_x_addr_richness", "feat_phone_exclusive", "feat_web_exclusive",
)


def prepare_pairs(df: DataFrame) -> DataFrame:
    """Raw pairs with normal forms of address, phone and website of both sides and their similarities."""
    norm = {}
    for side, prefix in (("conflated", ""), ("base", "base_")):
        norm |= {
            f"norm_{side}_addr": F.coalesce(tx.address_text(F.col(f"{prefix}addresses")), F.lit("")),
            f"norm_{side}_phone": tx.phone_digits(F.col(f"{prefix}phones")), f"norm_{side}_website": tx.website(F.col(f"{prefix}websites")),
        }
    rows = df.withColumns(norm)
    a = lambda x: F.col(f"norm_conflated_{x}")
    b = lambda x: F.col(f"norm_base_{x}")
    return rows.withColumns({
        "addr_similarity_ratio": sim.guarded(sim.ratio, a("addr"), b("addr")), "addr_token_sort": sim.guarded(sim.token_sort_ratio, a("addr"), b("addr")),
        "phone_similarity": sim.guarded(sim.ratio, a("phone"), b("phone")), "website_similarity": sim.guarded(sim.ratio, a("website"), b("website")),
    })


def add_fuzzy_scores(df: DataFrame, extract_first: bool = False) -> DataFrame:
    """Scores of five fields with their mean and sum; text is compared as stored unless ``extract_first``."""
    fields = {"name": "names", "phone": "phones", "web": "websites", "address": "addresses", "category": "categories"}

    def text(c: str, name: str) -> Column:
        raw = F.coalesce(F.col(c), F.lit(""))
        if not extract_first:
            return tx.display(raw)
        return tx.primary(raw) if name in ("name", "category") else tx.freeform_address(raw) if name == "address" else tx.first_url(raw)

    scores = {f"fuzzy_score_{n}": sim.fuzzy_score(text(f"base_{c}", n), text(c, n)) for n, c in fields.items()}
    rows = df.withColumns(scores)
    total = sum((F.col(c) for c in scores), F.lit(0.0))
    return rows.withColumns({"total_similarity": total / len(scores), "total_similarity_sum": total})


def legacy_scores(df: DataFrame) -> DataFrame:
    """The older weighted score of name, address, phone and website, and whether it reaches 0.7."""
    n, m = F.coalesce("names", F.lit("None")), F.coalesce("base_names", F.lit("None"))
    rows = df.withColumns({
        "name_tfidf_proxy": sim.token_set_ratio(n, m) / 100.0, "name_jaro": sim.jaro_winkler(F.col("names"), F.col("base_names")), "name_fuzz": sim.ratio(n, m) / 100.0,
        "score_address": sim.address_component_score(F.col("norm_conflated_addr"), F.col("norm_base_addr")), "score_phone": F.col("phone_similarity") / 100.0, "score_website": F.col("website_similarity") / 100.0,
    })
    rows = rows.withColumn("score_name", F.col("name_tfidf_proxy") * 0.3 + F.col("name_jaro") * 0.3 + F.col("name_fuzz") * 0.4)
    rows = rows.withColumn("match_score", F.col("score_name") * 0.3 + F.col("score_address") * 0.4 + F.col("score_phone") * 0.2 + F.col("score_website") * 0.1)
    return rows.withColumn("pred_label", F.when(F.col("match_score") >= 0.7, 1).otherwise(0))


def _one(c: Column) -> Column:
    return F.when(c, 1).otherwise(0)


def engineer_features(df: DataFrame, as_of: str, validate_phones: bool = False, valid_sites: DataFrame | None = None) -> DataFrame:
    """49 features of each pair as of a day; columns of ``df`` are kept.

    Phones are validated by shape if asked for; websites against a table (url, valid) of what was looked up before.
    Features of brand and socials are there only if their columns are.
    """
    if lacking := missing_columns(df, STAGES["features"]):
        raise KeyError(f"features need the columns {lacking}")
    kept = df.columns
    if valid_sites is not None:
        for side, c in (("match", "norm_conflated_website"), ("base", "norm_base_website")):
            looked = valid_sites.select(F.col("url").alias(c), F.col("valid").cast("int").alias(f"_{side}_site"))
            df = df.join(looked, c, "left")
    cells: dict[str, Column] = {"_addr": F.col("addr_similarity_ratio").try_cast("double") / 100.0}
    for side, p in SIDES.items():
        norm = "conflated" if side == "match" else "base"
        info = tx.sources_info(F.col(f"{p}sources"))
        cells |= {
            f"_{side}_name": tx.primary(F.col(f"{p}names")), f"_{side}_category": tx.primary(F.col(f"{p}categories")), f"_{side}_sources": info,
            f"_{side}_no_name": tx.primary_is_null(F.col(f"{p}names")), f"_{side}_no_category": tx.primary_is_null(F.col(f"{p}categories")),
            f"_{side}_phone": tx.phone_digits(F.col(f"norm_{norm}_phone")), f"_{side}_web": tx.website(F.col(f"norm_{norm}_website")),
            f"_{side}_addr_len": F.length(F.coalesce(f"norm_{norm}_addr", F.lit(""))),
        }
    df = df.withColumns(cells)
    one: dict[str, Column] = {}
    optional = {x: [c for c in (p + col for p in SIDES.values()) if c in kept] for x, col in (("brand", "brand"), ("social", "socials"))}
    day = F.lit(as_of).cast("timestamp")
    for side, p in SIDES.items():
        latest = F.col(f"_{side}_sources.latest")
        one |= {
            f"feat_{side}_exists_score": F.col(f"{p}confidence"), f"feat_{side}_addr_len": F.col(f"_{side}_addr_len"),
            f"feat_{side}_has_phone": _one(F.col(f"_{side}_phone") != ""), f"feat_{side}_has_web": _one(F.col(f"_{side}_web") != ""),
            f"feat_{side}_web_valid": F.coalesce(f"_{side}_site", F.lit(0)) if valid_sites is not None else F.lit(0),
            f"feat_{side}_phone_valid": _one(tx.phone_is_valid(F.col(f"_{side}_phone"))) if validate_phones else F.lit(0),
            f"feat_{side}_recency_days": F.coalesce(F.floor((F.unix_micros(day) - F.unix_micros(latest)) / F.lit(86_400_000_000)).cast("int"), F.lit(9999)),
        }
        for x, col in (("brand", "brand"), ("social", "socials")):
            if f"{p}{col}" in kept:
                one[f"feat_{side}_has_{x}"] = _one(tx.has_content(F.col(f"{p}{col}")))
    one |= {
        "feat_name_similarity": sim.guarded(sim.token_sort_ratio, F.col("_match_name"), F.col("_base_name")) / 100.0, "feat_addr_similarity": F.col("_addr"),
        "feat_phone_similarity": F.coalesce(F.col("phone_similarity").try_cast("double") / 100.0, F.lit(0.0)), "feat_web_similarity": F.coalesce(F.col("website_similarity").try_cast("double") / 100.0, F.lit(0.0)),
        "feat_phone_exact_match": _one((F.col("_match_phone") != "") & (F.col("_match_phone") == F.col("_base_phone"))),
        "feat_category_similarity": sim.guarded(sim.token_sort_ratio, F.col("_match_category"), F.col("_base_category")) / 100.0,
        "feat_category_exact_match": _one((F.col("_match_category") != "") & (F.col("_match_category") == F.col("_base_category"))),
        "feat_is_msft_match": _one(F.array_contains("_match_sources.datasets", "msft")), "feat_is_meta_match": _one(F.array_contains("_match_sources.datasets", "meta")),
        "feat_src_count_delta": F.col("_match_sources.n") - F.col("_base_sources.n"),
    }
    df = df.withColumns(one)
    f = lambda x: F.col(f"feat_{x}")
    two: dict[str, Column] = {"feat_existence_conf_delta": f("match_exists_score") - f("base_exists_score"), "feat_addr_richness_delta": f("match_addr_len") - f("base_addr_len")}
    for x, name in (("has_phone", "phone_presence_delta"), ("has_web", "web_presence_delta"), ("web_valid", "web_valid_delta"), ("phone_valid", "phone_valid_delta")):
        two[f"feat_{name}"] = f(f"match_{x}") - f(f"base_{x}")
    for x, both in optional.items():
        if len(both) == 2:
            two[f"feat_{x}_delta"] = f(f"match_has_{x}") - f(f"base_has_{x}")
    for side in SIDES:
        extra = [f(f"{side}_has_{x}") for x in optional if f"feat_{side}_has_{x}" in df.columns]
        filled = [_one(f(f"{side}_addr_len") > 0), _one((F.col(f"_{side}_name") != "") | F.col(f"_{side}_no_name")), _one((F.col(f"_{side}_category") != "") | F.col(f"_{side}_no_category"))]
        two[f"feat_{side}_completeness"] = sum([f(f"{side}_has_web"), *filled, *extra], f(f"{side}_has_phone"))
    two |= {
        "feat_recency_delta": f("base_recency_days") - f("match_recency_days"), "feat_name_addr_sim_product": f("name_similarity") * f("addr_similarity"),
        "feat_avg_similarity": (f("name_similarity") + f("addr_similarity") + f("phone_similarity") + f("web_similarity")) / 4.0, "feat_addr_dissimilarity": 1.0 - f("addr_similarity"),
        "feat_phone_exclusive": _one((f("match_has_phone") == 1) & (f("base_has_phone") == 0)), "feat_web_exclusive": _one((f("match_has_web") == 1) & (f("base_has_web") == 0)),
    }
    df = df.withColumns(two)
    df = df.withColumns({
        "feat_confidence_delta": f("existence_conf_delta"), "feat_completeness_delta": f("match_completeness") - f("base_completeness"), "feat_valid_count_delta": f("web_valid_delta") + f("phone_valid_delta"),
        "feat_adds_new_info": f("existence_conf_delta") * (1.0 - f("avg_similarity")), "feat_conf_x_addr_richness": f("existence_conf_delta") * F.greatest(f("addr_richness_delta"), F.lit(0)),
    })
    return df.select(*[F.col(f"`{c}`") for c in kept], *[c for c in df.columns if c.startswith("feat_")])
