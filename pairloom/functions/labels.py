"""Winners of attributes and labels of records, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.schemas import ATTRIBUTES, DECISIVE_FOR_NONE

TRUTH_ATTRIBUTES = ("phone", "web", "address", "category")


def plain(c: Column) -> Column:
    """Lower case without surrounding space; NULL becomes empty."""
    return F.coalesce(F.lower(F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")), F.lit(""))


#: The forms winners are written in.
FORMS = {"alt": "alt", "a": "alt", "m": "alt", "match": "alt", "base": "base", "b": "base", "both": "both", "t": "both", "none": "none"}


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for item in values.items() for x in item]), key)


def bound(cells: dict[str, Column], body: Callable[[dict[str, Column]], Column]) -> Column:
    """``body`` over values that are worked out once, however often it names them."""
    one = F.array(F.struct(*[c.alias(k) for k, c in cells.items()]))
    return F.get(F.transform(one, lambda s: body({k: s[k] for k in cells})), F.lit(0))


def winner_strict(c: Column) -> Column:
    """base, alt, both or none, with their short forms; anything else is NULL."""
    return _lookup(FORMS, plain(c))


def winner_lenient(c: Column) -> Column:
    """As ``winner_strict``, but NULL and unknown give none, and text that is blank gives base as in older results."""
    return F.when(c.isNull(), "none").otherwise(F.coalesce(_lookup(FORMS | {"": "base"}, plain(c)), F.lit("none")))


def real_as_alt(c: Column) -> Column:
    """A truth winner compared with golden ones: real counts as alt."""
    w = plain(c)
    return F.when(w == "real", "alt").otherwise(w)


def three_class_truth(c: Column) -> Column:
    """A golden 3-class label, of which match means alt."""
    w = plain(c)
    return F.when(w == "match", "alt").otherwise(w)


def _count(columns: list[Column], value: str) -> Column:
    return reduce(lambda a, b: a + b, [F.when(c == value, 1).otherwise(0) for c in columns])


def _winners(suffix: str) -> dict[str, Column]:
    return {a: F.col(f"attr_{a}_winner{suffix}") for a in ATTRIBUTES}


def label_4class(suffix: str = "") -> Column:
    """Record label: none if name, address and web all are; both if agreement outweighs the lead; else who leads."""
    def counted(w: dict[str, Column]) -> Column:
        nothing = reduce(lambda a, b: a & b, [w[a] == "none" for a in DECISIVE_FOR_NONE])
        cells = {"nothing": nothing, "both": _count(list(w.values()), "both"), "lead": _count(list(w.values()), "alt") - _count(list(w.values()), "base")}
        return bound(cells, rule)

    def rule(n: dict[str, Column]) -> Column:
        lead = n["lead"]
        return F.when(n["nothing"], "none").when((n["both"] > F.abs(lead)) | ((lead == 0) & (n["both"] > 0)), "both").when(lead > 0, "alt").when(lead < 0, "base").otherwise("none")

    return bound({a: winner_lenient(c) for a, c in _winners(suffix).items()}, counted)


def four_to_three(c: Column) -> Column:
    """alt and both stay, everything else is base."""
    return F.coalesce(_lookup({"alt": "alt", "both": "both"}, c), F.lit("base"))


def label_3class(suffix: str = "") -> Column:
    return four_to_three(label_4class(suffix))


def label_2class(suffix: str = "") -> Column:
    """base or alt by majority; ties go to name and address if they agree, then to phone, name, address, base."""
    def rule(w: dict[str, Column]) -> Column:
        lead = _count(list(w.values()), "alt") - _count(list(w.values()), "base")
        agreed = F.when((w["name"] == w["address"]) & w["name"].isin("alt", "base"), w["name"])
        first = [F.when(w[a].isin("alt", "base"), w[a]) for a in ("phone", "name", "address")]
        return F.when(lead > 0, "alt").when(lead < 0, "base").otherwise(F.coalesce(agreed, *first, F.lit("base")))

    return bound({a: winner_strict(c) for a, c in _winners(suffix).items()}, rule)


def label_4class_legacy(suffix: str = "") -> Column:
    """The older rule: three none, three both, majority, tie is both; short forms are unknown to it."""
    def rule(cells: dict[str, Column]) -> Column:
        w = list(cells.values())
        lead = _count(w, "alt") - _count(w, "base")
        return F.when(_count(w, "none") >= 3, "none").when(_count(w, "both") >= 3, "both").when(lead < 0, "base").when(lead > 0, "alt").otherwise("both")

    known = {x: x for x in ("alt", "base", "both")}
    return bound({a: F.coalesce(_lookup(known, plain(c)), F.lit("none")) for a, c in _winners(suffix).items()}, rule)


def binary_or_null(c: Column) -> Column:
    """1 for alt, match or both; 0 for base or none; NULL for the rest."""
    w = plain(c)
    return F.when(w.isin("alt", "match", "both"), 1).when(w.isin("base", "none"), 0)


def binary_or_zero(c: Column) -> Column:
    """1 for alt or both, else 0."""
    return F.when(plain(c).isin("alt", "both"), 1).otherwise(0)


def binary_alt_only(c: Column) -> Column:
    """1 for alt or match, else 0."""
    return F.when(plain(c).isin("alt", "match"), 1).otherwise(0)


def binary_name(c: Column) -> Column:
    """The name alt for alt or both, base for the rest."""
    return F.when(plain(c).isin("alt", "both"), "alt").otherwise("base")


def golden_label_by_margin(base_score: Column, alt_score: Column) -> Column:
    """base or alt where one leads by two, else abstain."""
    return F.when(base_score - alt_score >= 2, "base").when(alt_score - base_score >= 2, "alt").otherwise("abstain")


def _led(w: list[Column], tie: str) -> Column:
    lead = _count(w, "alt") - _count(w, "base")
    return F.when(lead > 0, "alt").when(lead < 0, "base").when(_count(w, "both") > 0, "both").otherwise(tie)


def truth_4class(tie_default: str = "both") -> Column:
    """Label from truth winners, real as alt; ties are both if any is, else ``tie_default``."""
    return bound({a: real_as_alt(F.col(f"truth_{a}_winner")) for a in TRUTH_ATTRIBUTES}, lambda w: _led(list(w.values()), tie_default))


def truth_2class() -> Column:
    """alt only if more truth winners are alt than base; real is neither."""
    return bound({a: plain(F.col(f"truth_{a}_winner")) for a in TRUTH_ATTRIBUTES}, lambda w: F.when(_count(list(w.values()), "alt") > _count(list(w.values()), "base"), "alt").otherwise("base"))


def implied_name_winner() -> Column:
    """Who wins most of the other attributes; ties are both if any is, else base."""
    return bound({a: plain(F.col(f"truth_{a}_winner")) for a in TRUTH_ATTRIBUTES}, lambda w: _led(list(w.values()), "base"))


def golden_value(winner: Column, base: Column, alt: Column) -> Column:
    """The value a golden winner points to: that of alt for alt, of base for all others."""
    return F.when(winner_strict(winner) == "alt", alt).otherwise(base)


def highest_confidence() -> Column:
    """alt where its confidence is higher, else base; a missing one never wins."""
    return F.when(F.coalesce(F.nanvl("confidence", F.lit(None)), F.lit(-1.0)) > F.coalesce(F.nanvl("base_confidence", F.lit(None)), F.lit(float("inf"))), "alt").otherwise("base")


def quality_label(match: Column, base: Column) -> Column:
    """1 where the alt side's quality is higher."""
    return F.when(match > base, 1).otherwise(0)


def quality_score(side: str) -> Column:
    """Completeness twice, validity, and half a point for data of the last year; ``side`` is match or base."""
    recent = F.when(F.col(f"feat_{side}_recency_days") < 365, 0.5).otherwise(0.0)
    return F.col(f"feat_{side}_completeness") * 2.0 + F.col(f"feat_{side}_web_valid") + F.col(f"feat_{side}_phone_valid") + recent


def similarity_label(name: Column, address: Column, name_least: float = 0.80, address_least: float = 0.78) -> Column:
    """1 where both are alike, 0 where neither is, NULL between."""
    return F.when((name >= name_least) & (address >= address_least), 1).when((name < name_least) & (address < address_least), 0)


def both_detector() -> Column:
    """Sides so alike that both may stand: same address and name, base no poorer, like confidence, nothing exclusive."""
    full = reduce(lambda a, b: a & b, [F.col(f"feat_{s}_has_{x}") == 1 for s in ("match", "base") for x in ("phone", "web")])
    poorer = (F.col("feat_completeness_delta") < 0) | ((F.col("feat_completeness_delta") == 0) & full)
    alike = (F.col("feat_addr_similarity") >= 0.97) & (F.col("feat_name_similarity") >= 0.90)
    alone = (F.col("feat_phone_exclusive") == 0) & (F.col("feat_web_exclusive") == 0)
    return F.coalesce(alike & poorer & (F.abs("feat_existence_conf_delta") <= 0.10) & alone, F.lit(False))


def two_stage(accepted: Column, is_both: Column) -> Column:
    """base, or of accepted rows both or match."""
    return F.when(~accepted, "base").when(is_both, "both").otherwise("match")


def cascade(p_none: Column, refined: Column, threshold: float = 0.5) -> Column:
    """none where its probability reaches the threshold, else the refiner's class."""
    return F.when(p_none >= threshold, "none").otherwise(refined)
