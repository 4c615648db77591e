"""Pieces of SQL that several oracle queries share."""

from __future__ import annotations

ATTRIBUTES = ("name", "phone", "web", "address", "category")


def plain(c: str) -> str:
    return f"coalesce(lower(regexp_replace(CAST({c} AS VARCHAR), '^\\s+|\\s+$', '', 'g')), '')"


def strict(c: str) -> str:
    return f"(CASE WHEN {plain(c)} IN ('alt','a','m','match') THEN 'alt' WHEN {plain(c)} IN ('base','b') THEN 'base' WHEN {plain(c)} IN ('both','t') THEN 'both' WHEN {plain(c)} = 'none' THEN 'none' END)"


def lenient(c: str) -> str:
    return f"(CASE WHEN {c} IS NULL THEN 'none' WHEN {plain(c)} = '' THEN 'base' ELSE coalesce({strict(c)}, 'none') END)"


def count(columns: list[str], value: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {c} = '{value}' THEN 1 ELSE 0 END" for c in columns) + ")"


def winners(source: str, suffix: str, form: str, extra: str = "") -> str:
    """A subquery with w_{attribute} of every row."""
    shape = {"strict": strict, "lenient": lenient, "legacy": lambda c: f"(CASE WHEN {plain(c)} IN ('alt','base','both') THEN {plain(c)} ELSE 'none' END)"}[form]
    return "(SELECT *" + extra + ", " + ", ".join(f"{shape(f'attr_{a}_winner{suffix}')} AS w_{a}" for a in ATTRIBUTES) + f" FROM {source})"


W = [f"w_{a}" for a in ATTRIBUTES]
BOTH, LEAD = count(W, "both"), f"({count(W, 'alt')} - {count(W, 'base')})"
FOUR = f"(CASE WHEN w_name = 'none' AND w_address = 'none' AND w_web = 'none' THEN 'none' WHEN {BOTH} > abs({LEAD}) OR ({LEAD} = 0 AND {BOTH} > 0) THEN 'both' WHEN {LEAD} > 0 THEN 'alt' WHEN {LEAD} < 0 THEN 'base' ELSE 'none' END)"
THREE = f"(CASE WHEN {FOUR} IN ('alt','both') THEN {FOUR} ELSE 'base' END)"
TWO = f"""(CASE WHEN {LEAD} > 0 THEN 'alt' WHEN {LEAD} < 0 THEN 'base'
  ELSE coalesce(CASE WHEN w_name = w_address AND w_name IN ('alt','base') THEN w_name END, CASE WHEN w_phone IN ('alt','base') THEN w_phone END, CASE WHEN w_name IN ('alt','base') THEN w_name END, CASE WHEN w_address IN ('alt','base') THEN w_address END, 'base') END)"""
LEGACY = f"(CASE WHEN {count(W, 'none')} >= 3 THEN 'none' WHEN {BOTH} >= 3 THEN 'both' WHEN {LEAD} < 0 THEN 'base' WHEN {LEAD} > 0 THEN 'alt' ELSE 'both' END)"


def share(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END)"


def f1(tp: str, fp: str, fn: str) -> str:
    return share(f"2.0 * ({tp})", f"2.0 * ({tp}) + ({fp}) + ({fn})")


def class_metrics(rows: str, labels: tuple[str, ...], by: str = "") -> str:
    """n, accuracy, macro_f1 and f1 of each label over rows with t and p."""
    f = {x: f1(f"sum(CASE WHEN t = '{x}' AND p = '{x}' THEN 1 ELSE 0 END)", f"sum(CASE WHEN t <> '{x}' AND p = '{x}' THEN 1 ELSE 0 END)", f"sum(CASE WHEN t = '{x}' AND p <> '{x}' THEN 1 ELSE 0 END)") for x in labels}
    head = f"{by}, " if by else ""
    return (
        f"SELECT {head}CAST(count(*) AS BIGINT) AS n, round({share('sum(CASE WHEN t = p THEN 1 ELSE 0 END)', 'count(*)')}, 6) AS accuracy, "
        f"round(({' + '.join(f.values())}) / {float(len(labels))}, 6) AS macro_f1, " + ", ".join(f"round({v}, 6) AS f1_{x}" for x, v in f.items()) + f" FROM {rows}" + (f" GROUP BY {by}" if by else "")
    )
