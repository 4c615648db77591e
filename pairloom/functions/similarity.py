"""String similarities. The kernels Spark lacks run in Arrow batches; each distinct pair of a batch is scored once."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from pairloom.functions.text import address_parts


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by one long bit vector."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio_of(a: str, b: str) -> float:
    """200 times the common subsequence over both lengths; two empty strings are alike."""
    total = len(a) + len(b)
    return 200.0 * lcs(a, b) / total if total else 100.0


def token_sort_of(a: str, b: str) -> float:
    return ratio_of(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_of(a: str, b: str) -> float:
    """Best ratio of common words, common words with the rest of a, and with the rest of b."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 100.0
    wide = [" ".join(p for p in (both, s) if p) for s in (left, right)]
    found = [ratio_of(*wide)]
    if both:
        found += [ratio_of(both, w) for w in wide]
    return max(found)


def partial_of(a: str, b: str) -> float:
    """Best ratio of the shorter string against windows of its length in the longer, and shorter ones at the ends."""
    if not a and not b:
        return 100.0
    if not a or not b:
        return 0.0

    def best(short: str, long: str) -> float:
        n, top = len(short), 0.0
        for start in range(1 - n, len(long)):
            window = long[max(0, start) : start + n]
            if window and 200.0 * len(window) / (len(window) + n) > top:
                top = max(top, ratio_of(short, window))
            if top == 100.0:
                break
        return top

    if len(a) == len(b):
        return max(best(a, b), best(b, a))
    return best(a, b) if len(a) < len(b) else best(b, a)


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro similarity with a bonus of a tenth per common leading character, up to four, above 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, left = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                left.append(ch)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [ch for ch, t in zip(b, taken, strict=True) if t]
    swapped = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def _scored(kernel: Callable[[str, str], float], a: Column, b: Column) -> Column:
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        out = []
        for pair in zip(left, right, strict=True):
            if pair[0] is None or pair[1] is None:
                out.append(None)
                continue
            if pair not in known:
                known[pair] = kernel(*pair)
            out.append(known[pair])
        return pd.Series(out, dtype="float64")

    # equal strings need no kernel
    return F.when(a == b, F.lit(None)).otherwise(F.pandas_udf(run, DoubleType())(F.when(a != b, a), F.when(a != b, b)))


def ratio(a: Column, b: Column) -> Column:
    """0 to 100; NULL if a side is NULL."""
    return F.when(a == b, 100.0).otherwise(_scored(ratio_of, a, b))


def token_sort_ratio(a: Column, b: Column) -> Column:
    return F.when(a == b, 100.0).otherwise(_scored(token_sort_of, a, b))


def token_set_ratio(a: Column, b: Column) -> Column:
    return F.when((a == b) & (F.trim(a) != ""), 100.0).when(a == b, 0.0).otherwise(_scored(token_set_of, a, b))


def partial_ratio(a: Column, b: Column) -> Column:
    return F.when(a == b, 100.0).otherwise(_scored(partial_of, a, b))


def jaro_winkler(a: Column, b: Column) -> Column:
    """0 to 1; NULL counts as 0."""
    return F.coalesce(F.when(a == b, 1.0).otherwise(_scored(jaro_winkler_of, a, b)), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of lower-case words; 0 if a side has none. Built-in expressions only."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+"), lambda w: w != ""))
    x, y = words(a), words(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def guarded(score: Callable[[Column, Column], Column], a: Column, b: Column) -> Column:
    """A score that is 0 if a side is empty or NULL; the kernel does not see such pairs."""
    filled = (a != "") & (b != "")
    return F.coalesce(F.when(filled, score(F.when(filled, a), F.when(filled, b))), F.lit(0.0))


def fuzzy_score(a: Column, b: Column) -> Column:
    """Mean of four scores, 0 to 1; 1 if both sides are empty, 0 if one is."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    mean = (token_sort_ratio(a, b) + partial_ratio(a, b) + token_set_ratio(a, b)) / 100.0 + jaro_winkler(a, b)
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(mean / 4.0)


def fuzzy_match(a: Column, b: Column, threshold: float = 85.0) -> Column:
    """Whether either ratio reaches the threshold; with an empty side, whether both are.

    Pairs whose lengths alone keep both ratios below the threshold do not reach the kernel.
    """
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    joined = lambda c: F.array_join(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""), " ")

    def bound(x: Column, y: Column) -> Column:
        return F.coalesce(F.try_divide(F.least(F.length(x), F.length(y)) * 200.0, F.length(x) + F.length(y)), F.lit(100.0))

    near = (bound(a, b) >= threshold) | (bound(joined(a), joined(b)) >= threshold)
    x, y = F.when(near, a), F.when(near, b)
    scored = F.greatest(ratio(x, y), token_sort_ratio(x, y)) >= threshold
    return F.when((a == "") | (b == ""), a == b).otherwise(F.coalesce(scored, F.lit(False)))


def address_component_score(a: Column, b: Column) -> Column:
    """0.4 for the number, 0.4 for the street, 0.2 for the unit."""
    x, y = address_parts(a), address_parts(b)
    number = F.when((x["num"] == "") & (y["num"] == ""), 0.5).when(x["num"] == y["num"], 1.0).otherwise(0.0)
    unit = F.when(x["unit"] == y["unit"], 1.0).otherwise(0.0)
    return number * 0.4 + token_sort_ratio(x["street"], y["street"]) / 100.0 * 0.4 + unit * 0.2


def value_similarity(attribute: str, a: Column, b: Column) -> Column:
    """0 to 100 for one attribute: phones and websites alike or not, the rest by ratio."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    if attribute in ("phone", "web"):
        inner = F.when(a == b, 100.0).otherwise(0.0)
    elif attribute == "address":
        inner = ratio(a, b)
    elif attribute in ("name", "category"):
        inner = token_sort_ratio(a, b)
    else:
        inner = F.lit(0.0)
    return F.when((a == "") & (b == ""), 100.0).when((a == "") | (b == ""), 0.0).otherwise(inner)
