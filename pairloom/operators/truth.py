"""External truth compared with both sides of a pair, and winners by rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions import text as tx
from pairloom.functions.labels import TRUTH_ATTRIBUTES, plain
from pairloom.functions.similarity import fuzzy_match

#: Where the value of each attribute comes from: the columns of alt and base that are tried in turn.
VALUE_COLUMNS = {
    "phone": (("norm_conflated_phone", "phones"), ("norm_base_phone", "base_phones")), "web": (("websites", "norm_conflated_website"), ("base_websites", "norm_base_website")),
    "category": (("categories",), ("base_categories",)), "address": (("addresses", "norm_conflated_addr"), ("base_addresses", "norm_base_addr")),
}


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def comparable(attribute: str, c: Column) -> Column:
    """The form in which values of an attribute are compared."""
    if attribute == "phone":
        return tx.phone_digits(c)
    if attribute == "web":
        return tx.website(c)
    if attribute == "address":
        return F.coalesce(tx.address_text(c), F.lit(""))
    return tx.stripped(F.lower(_text(c)))


def compared(df: DataFrame, real: dict[str, Column], base: dict[str, Column], alt: dict[str, Column]) -> DataFrame:
    """``df`` with _{attribute}_winner and _{attribute}_value: which side the real value speaks for.

    Without a real value base wins unless both sides agree or only alt has a value; with nothing anywhere alt wins an
    empty value. A real value that neither side has wins itself. Websites match exactly or nearly, phones exactly,
    categories and addresses nearly. Done in steps, so that each form and each kernel is worked out once.
    """
    kept = df.columns
    sides = {"r": real, "b": base, "a": alt}
    df = df.withColumns({f"_{a}_text_{x}": _text(c[a]) for a in real for x, c in sides.items()})
    df = df.withColumns({f"_{a}_{x}": comparable(a, F.col(f"_{a}_text_{x}")) for a in real for x in sides})
    hits: dict[str, Column] = {}
    for attribute in real:
        r = F.col(f"_{attribute}_r")
        for x in ("b", "a"):
            side = F.col(f"_{attribute}_{x}")
            if attribute == "phone":
                hits[f"_{attribute}_is_{x}"] = r == side
            else:
                near = fuzzy_match(F.when(r != "", r), F.when(r != "", side))
                exact = (r == F.col(f"_{attribute}_b")) | (r == F.col(f"_{attribute}_a"))
                hits[f"_{attribute}_is_{x}"] = F.when(exact, r == side).otherwise(near) if attribute == "web" else near
    df = df.withColumns(hits)
    winners, values = {}, {}
    for a in real:
        r, b, alt_form, tr_, tb, ta = (F.col(f"_{a}_{x}") for x in ("r", "b", "a", "text_r", "text_b", "text_a"))
        without = F.when((b != "") & (b == alt_form), "both").when(b != "", "base").otherwise("alt")
        is_b, is_a = F.col(f"_{a}_is_b"), F.col(f"_{a}_is_a")
        winners[f"_{a}_winner"] = F.when(r == "", without).when(is_b & is_a, "both").when(is_b, "base").when(is_a, "alt").otherwise("real")
        either = F.when(tb != "", tb).otherwise(ta)
        nothing = F.when(b != "", b).otherwise(alt_form) if a in ("phone", "web") else either
        w = F.col(f"_{a}_winner")
        values[f"_{a}_value"] = F.when(r == "", nothing).when(w == "both", either).when(w == "base", tb).when(w == "alt", ta).otherwise(tr_)
    df = df.withColumns(winners).withColumns(values)
    return df.select(*[F.col(f"`{c}`") for c in kept], *[f"_{a}_{x}" for a in real for x in ("winner", "value", "r")])


def side_value(df: DataFrame, attribute: str, base: bool) -> Column:
    """The value of one side: the first filled one of its columns."""
    filled = [F.nullif(_text(F.col(c)), F.lit("")) for c in VALUE_COLUMNS[attribute][int(base)] if c in df.columns]
    value = F.coalesce(*filled, F.lit("")) if filled else F.lit("")
    if attribute == "web":
        return tx.first_url(value)
    if attribute == "category":
        return F.when(value.startswith("{"), tx.primary(value)).otherwise(value)
    return value


def compare_rows(df: DataFrame, real: dict[str, Column], source: str, allow_fallback: bool = True) -> DataFrame:
    """``df`` with winner, value and comparable value of each attribute.

    Without ``allow_fallback`` an attribute without a real value is no_data.
    """
    sides = [{a: side_value(df, a, base) for a in TRUTH_ATTRIBUTES} for base in (True, False)]
    rows = compared(df, real, *sides)
    cells: dict[str, Column] = {}
    for a in TRUTH_ATTRIBUTES:
        winner, value = F.col(f"_{a}_winner"), F.col(f"_{a}_value")
        if not allow_fallback:
            lacking = F.col(f"_{a}_r") == ""
            winner, value = F.when(lacking, "no_data").otherwise(winner), F.when(lacking, "").otherwise(value)
        cells |= {f"truth_{a}_winner": winner, f"truth_{a}_value": value}
    rows = rows.withColumns(cells)
    rows = rows.withColumns({f"truth_{a}_value_norm": comparable(a, F.col(f"truth_{a}_value")) for a in TRUTH_ATTRIBUTES} | {"truth_source": F.lit(source)})
    return rows.drop(*[f"_{a}_{x}" for a in TRUTH_ATTRIBUTES for x in ("winner", "value", "r")])


def rule_based_truth(df: DataFrame, prefer_alt: bool = True) -> DataFrame:
    """Truth without a source: the alt side's values are real, or none are, so that base wins."""
    real = {a: side_value(df, a, False) if prefer_alt else F.lit("") for a in TRUTH_ATTRIBUTES}
    return compare_rows(df, real, "rule_based")


def external_truth(df: DataFrame, truth: DataFrame, keys: list[str], source: str, allow_fallback: bool = True) -> DataFrame:
    """Truth looked up in a table (keys, phone, web, category, address); of repeated keys the first whole row in order counts."""
    first = truth.groupBy(*keys).agg(F.min(F.struct(*TRUTH_ATTRIBUTES)).alias("_first"))
    once = first.select(*keys, *[F.col(f"_first.{a}").alias(f"_real_{a}") for a in TRUTH_ATTRIBUTES])
    joined = df.join(once, keys, "left")
    real = {a: _text(F.col(f"_real_{a}")) for a in TRUTH_ATTRIBUTES}
    return compare_rows(joined, real, source, allow_fallback).drop(*[f"_real_{a}" for a in TRUTH_ATTRIBUTES])


def merge_real(*candidates: Column) -> Column:
    """The first filled of several real values."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in candidates], F.lit(""))


def phone_winner(base: Column, alt: Column, base_region: Column, alt_region: Column) -> Column:
    """Which phone is valid, with the corrected numbers; one invalid as written is tried in its region, else in the US."""
    def valid(c: Column, region: Column) -> Column:
        return F.coalesce(tx.phone_e164(c), tx.phone_e164(c, F.coalesce(region, F.lit("US"))))

    b, a = valid(base, base_region), valid(alt, alt_region)
    winner = F.when(a.isNotNull() & b.isNotNull(), "both").when(b.isNotNull(), "base").when(a.isNotNull(), "alt").otherwise("none")
    return F.struct(winner.alias("winner"), b.alias("base_phone_with_country"), a.alias("alt_phone_with_country"))


def web_winner(base_reached: Column, alt_reached: Column) -> Column:
    """Which website answers."""
    b, a = F.coalesce(base_reached, F.lit(False)), F.coalesce(alt_reached, F.lit(False))
    return F.when(a & b, "both").when(b, "base").when(a, "alt").otherwise("none")


def address_winner(base: Column, alt: Column) -> Column:
    """both for equal address sets, the strict superset, the more complete one, else NULL: for a hand to decide."""
    def listed(c: Column) -> Column:
        return F.coalesce(F.from_json(F.when(F.trim(c).startswith("{"), F.concat(F.lit("["), c, F.lit("]"))).otherwise(c), "array<string>"), F.array().cast("array<string>"))

    b, a = listed(base), listed(alt)
    more_b, more_a = F.size(F.array_except(b, a)), F.size(F.array_except(a, b))
    full_b, full_a = tx.address_completeness(base), tx.address_completeness(alt)
    return F.when((more_b == 0) & (more_a == 0), "both").when(more_a == 0, "base").when(more_b == 0, "alt").when(full_b > full_a, "base").when(full_a > full_b, "alt")


def equality_winner(base: Column, alt: Column) -> Column:
    """both for equal text, else NULL: for a hand to decide."""
    return F.when(plain(base) == plain(alt), "both")


def winner_agreement(truth: str, golden: str) -> Column:
    """agree, disagree, or suggested where truth brings a value of its own."""
    t, g = plain(F.col(truth)), plain(F.col(golden))
    return F.when(t == "real", "suggested").when(t == g, "agree").otherwise("disagree")


def all_or_any(columns: list[str], value: str, every: bool) -> Column:
    """Whether all, or any, of the columns have a value."""
    hits = [plain(F.col(c)) == value for c in columns]
    return reduce(lambda a, b: (a & b) if every else (a | b), hits)
