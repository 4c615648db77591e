"""Consensus of opinions: planted annotators, roles, copies and edge cases."""

from __future__ import annotations

import random

from pairloom.llm.consensus import LABELS, decide, fit, gathered, reliabilities, winner

ITEM = ["id"]
SCHEMA = "id string, annotator string, label string, at timestamp"


def planted(n: int = 400, seed: int = 1):
    rng = random.Random(seed)
    swap = {"alt": "base", "base": "alt", "both": "none", "none": "both"}
    truth, rows = {}, []
    for i in range(n):
        t = truth[str(i)] = rng.choice(LABELS)
        say = lambda p: t if rng.random() < p else rng.choice([x for x in LABELS if x != t])
        answers = {"good": say(0.95), "fair": say(0.8), "poor": say(0.45), "swapped": swap[say(0.93)]}
        weak = say(0.6)
        answers |= {"weak": weak, "copier": weak if rng.random() < 0.97 else rng.choice(LABELS), "stuck": "both"}
        rows += [(str(i), a, v, None) for a, v in answers.items() if rng.random() < 0.8]
    return truth, rows


def test_planted_truth_is_found(spark):
    truth, rows = planted()
    items = gathered(spark.createDataFrame(rows, SCHEMA), ITEM)
    model = fit(items)
    found = {r.id: r for r in decide(items, ITEM, model).collect()}
    assert sum(found[i].winner == t for i, t in truth.items() if i in found) / len(found) > 0.93
    assert model.roles["swapped"] == (1, 0, 3, 2) and "good" not in {k for k, v in model.roles.items() if v != (0, 1, 2, 3)}
    assert model.ability["good"] > model.ability["fair"] > model.ability["poor"]
    pair = max(model.depends.get(("copier", "weak"), 0), model.depends.get(("weak", "copier"), 0))
    assert pair > 0.5 and ("good", "fair") not in model.depends
    told = {r.annotator: r for r in reliabilities(items, decide(items, ITEM, model), ITEM, model).collect()}
    assert told["good"].kappa > 0.8 and told["swapped"].roles and abs(told["stuck"].kappa) < 0.2


def test_edges(spark):
    rows = [("a", "x", "alt", None), ("a", "x", "alt", None), ("a", "y", None, None), (None, "x", "alt", None), ("b", None, "alt", None), ("c", "x", "odd", None), ("d", "x", "alt", None), ("d", "y", "base", None)]
    items = gathered(spark.createDataFrame(rows, SCHEMA), ITEM)
    found = {r.id: r for r in decide(items, ITEM, fit(items)).collect()}
    assert set(found) == {"a", "d"} and found["a"].n_annotators == 1 and found["a"].agreement is None and found["d"].agreement < 0
    empty = gathered(spark.createDataFrame([], SCHEMA), ITEM)
    assert decide(empty, ITEM, fit(empty)).count() == 0


def test_last_opinion_counts_and_forms(spark):
    import datetime as dt

    from pyspark.sql import functions as F

    rows = [("a", "x", "alt", dt.datetime(2025, 1, 1)), ("a", "x", "base", dt.datetime(2025, 2, 1))]
    said = gathered(spark.createDataFrame(rows, SCHEMA), ITEM).first().said
    assert [(s.annotator, s.label) for s in said] == [("x", "base")]
    df = spark.createDataFrame([("Match\t",), (" b",), ("T",), ("None",), ("?",), ("",), (None,)], "w string")
    assert [r[0] for r in df.select(winner(F.col("w"))).collect()] == ["alt", "base", "both", "none", None, None, None]
