"""Label rules: vectors, every combination, invariants."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from pairloom.functions import labels as lb
from pairloom.schemas import ATTRIBUTES, domain_offenders, require_columns, validate

LETTERS = {"N": "none", "A": "alt", "B": "base", "O": "both"}
VECTORS = {
    "alt": "ANOOA AOAAA AONAB AONAO AOOAA BNNAA NAOAB OAOAA ONAOA OOAAA OONAA", "base": "ABBAB BABBA BABBB BAOBB BBABO BBBBO BBNNO BBNOO BBOBO BBONO BBOON BNNBO BNOBA BNOBB BNOOB OBBBO OBOBN ONBBA ONOBB OONBB",
    "both": "AOABO AOOOA BAOBA BBOOO BNNOO BONOO BOOAA BOOAB BOOOA BOOOO OABBA OBAOO OBNOO OBOOO ONANO ONOOO OOAOO OOOAA OOOAO OOOBA OOOOB OOOOO",
}


@pytest.fixture(scope="module")
def combos(spark):
    rows = [("".join(c), *(LETTERS[x] for x in c)) for c in itertools.product("NABO", repeat=5)]
    df = spark.createDataFrame(rows, "code string, " + ", ".join(f"attr_{a}_winner string" for a in ATTRIBUTES))
    found = df.select("code", lb.label_4class().alias("four"), lb.label_3class().alias("three"), lb.label_2class().alias("two"), lb.label_4class_legacy().alias("old")).collect()
    return {r.code: r for r in found}


def test_published_vectors(combos):
    for label, codes in VECTORS.items():
        assert {combos[c].four for c in codes.split()} == {label}
    assert [combos[c].four for c in ("OOONN", "ABNNN", "AABON", "AABOO", "NNNNN", "ABONN")] == ["both", "none", "alt", "both", "none", "both"]
    assert {combos[c].old for c in ("AABAA", "BBAAA", "OAAOA")} == {"alt"} and {combos[c].old for c in ("ABOBB", "BNNAB")} == {"base"} and {combos[c].old for c in ("ANONB", "OOOOO")} == {"both"}


def test_invariants(combos):
    swap = str.maketrans("AB", "BA")
    for code, r in combos.items():
        assert r.three == {"alt": "alt", "both": "both"}.get(r.four, "base")
        other = combos[code.translate(swap)].four
        assert other == {"alt": "base", "base": "alt"}.get(r.four, r.four)
        if code[0] == code[2] == code[3] == "N":
            assert r.four == "none"
        lead = code.count("A") - code.count("B")
        if lead:
            assert r.two == ("alt" if lead > 0 else "base")


def test_forms(spark):
    df = spark.createDataFrame([(w,) for w in ("M", " b\t", "T", "", None, "?", "match", "NONE")], "w string")
    got = [tuple(r) for r in df.select(lb.winner_strict(F.col("w")), lb.winner_lenient(F.col("w"))).collect()]
    assert got == [("alt", "alt"), ("base", "base"), ("both", "both"), (None, "base"), (None, "none"), (None, "none"), ("alt", "alt"), ("none", "none")]


def test_schema_checks(spark):
    df = spark.createDataFrame([("1", "match"), ("2", "odd"), ("3", None)], "id string, 3class_testlabels string")
    with pytest.raises(ValueError, match="CRITICAL"):
        require_columns(df, ["id", "nope"], "x")
    with pytest.raises(ValueError, match="odd"):
        validate(df, "golden", {"3class_testlabels": ("alt", "match", "none")})
    assert domain_offenders(df, {"3class_testlabels": ("alt", "match")}).collect()[0]["value"] == "odd"


def test_truth_ties(spark):
    df = spark.createDataFrame([("real", "base", "x", ""), ("real", "alt", None, "base")], ", ".join(f"truth_{a}_winner string" for a in lb.TRUTH_ATTRIBUTES))
    got = [tuple(r) for r in df.select(lb.truth_4class(), lb.truth_4class("none"), lb.truth_2class(), lb.implied_name_winner()).collect()]
    assert got == [("both", "none", "base", "base"), ("alt", "alt", "base", "base")]
