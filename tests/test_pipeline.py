"""Pipeline, splits, running sums, models kept and blended, and forms checked against values written out."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from pairloom.functions import text as tx
from pairloom.operators import joins as jn
from pairloom.operators import metrics as me
from pairloom.operators import models as mo
from pairloom.operators import pipeline as pl
from pairloom.operators import sampling as sa
from pairloom.operators import truth as tr


def told(spark, rows, expression):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], "c string").select(expression(F.col("c"))).collect()]


def test_forms(spark):
    assert told(spark, ["12 sunset blvd, los angeles, CA, 90001", "1 high st, leeds, england", "5 bay st, toronto, on m5v", "x", None, "a, uk"], tx.region_of) == ["US", "GB", "CA", None, None, "GB"]
    assert told(spark, ["1 main avenue", "77 river lane", "1 main st, NY 10001", "1 st", None], tx.address_score) == [1, 1, 3, 0, 0]
    assert told(spark, ["call +1 415 555 0199 now", "415-555-01999", "1-800-555-0199", None], tx.first_phone) == ["+1 415 555 0199", "", "1-800-555-0199", ""]
    assert told(spark, ["at 12 Old Mill Road, York! yes", "no 5 here", "7 Elm St"], tx.first_street) == ["12 Old Mill Road, York", "", "7 Elm St"]


def test_running_sums_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.random(), rng.randrange(2), rng.randrange(1, 9)) for _ in range(500)]
    got = {r.s: (r.run_a, r.run_b, r.all_a) for r in me.running_sums(spark.createDataFrame(rows, "s double, a int, b int").repartition(5), "s", ["a", "b"]).collect()}
    a = b = 0
    for s, x, y in sorted(rows):
        a, b = a + x, b + y
        assert got[s][:2] == (a, b)
    assert len(got) == 500 and {v[2] for v in got.values()} == {a}
    assert me.running_sums(spark.createDataFrame([], "s double, a int"), "s", ["a"]).count() == 0


def test_split_negatives_and_lookup(spark):
    df = spark.createDataFrame([(str(i), "x" if i % 3 else None, "n") for i in range(300)], "id string, label string, is_it string")
    parts = {(r.label, r.is_test): r["count"] for r in sa.stratified_split(df, "id", "label", 0.2, slices=4).groupBy("label", "is_test").count().collect()}
    assert parts == {("x", True): 40, ("x", False): 160, (None, True): 20, (None, False): 80}
    pairs = spark.createDataFrame([(f"a{i}", f"b{i}", "{}", "{}", f'[{{"locality":"t{i % 2}"}}]', '[{"locality":"t0"}]') for i in range(8)], "id string, base_id string, names string, base_names string, addresses string, base_addresses string")
    assert sa.random_negatives(pairs, 10).count() == 10 and sa.random_negatives(pairs, 1_000).count() == 32
    table = spark.createDataFrame([("k", "z", 1), ("k", "a", 2)], "k string, v string, o int")
    asked = spark.createDataFrame([("k",)], "k string")
    assert jn.looked_up(asked, table, "k", "v", "v2").first().v2 == "z" and jn.looked_up(asked, table, "k", "v", "v2", order="o").first().v2 == "a"


def test_truth_takes_one_whole_row(spark):
    df = spark.createDataFrame([("i", "111", "222")], "id string, norm_base_phone string, norm_conflated_phone string")
    known = spark.createDataFrame([("i", "222", "z", "", ""), ("i", "333", "a", "", "")], "id string, phone string, web string, address string, category string")
    done = tr.external_truth(df, known, ["id"], "table", allow_fallback=False).first()
    assert (done.truth_phone_winner, done.truth_web_value_norm) == ("alt", "z")


def test_models_kept_blended_and_searched(spark, tmp_path):
    rng = random.Random(2)
    rows = [(str(i), x := rng.random(), "alt" if x + 0.1 * rng.random() > 0.5 else "base") for i in range(200)]
    df = spark.createDataFrame(rows, "id string, f double, y string")
    model = mo.fit(df, ["f"], F.col("y"), ("base", "alt"), mo.logistic())
    mo.save(model, str(tmp_path / "m"))
    one, two = (mo.predict(m, df, ["f"], ("base", "alt"), "m").select("id", "m_pred").collect() for m in (model, mo.load(str(tmp_path / "m"))))
    assert sorted(one) == sorted(two)
    held = mo.out_of_fold(df, "id", ["f"], F.col("y"), ("base", "alt"), {"a": mo.logistic, "b": mo.stump}, k=2)
    best = mo.blend_sweep(held, "a", "b", "alt", [0.0, 0.5, 1.0], [0.5]).collect()
    assert held.count() == 200 and len(best) == 3 and all(r.n == 200 and r.accuracy > 0.85 for r in best)
    found = mo.grid_search(df, "id", ["f"], F.col("y"), ("base", "alt"), {"stump": mo.stump, "logistic": mo.logistic}, k=2).collect()
    assert {r.name for r in found} == {"stump", "logistic"} and found[0].balanced_accuracy >= found[1].balanced_accuracy > 0.8
    odds = spark.range(1).select(mo.sigmoid(F.lit(1000.0)), mo.log_odds(F.lit(1.0)), mo.sigmoid(mo.log_odds(F.lit(0.3)))).first()
    assert odds[0] < 1 + 1e-12 and odds[1] < 14 and abs(odds[2] - 0.3) < 1e-9


def test_thresholds(spark):
    df = spark.createDataFrame([(i / 100, int(i >= 40)) for i in range(100)], "s double, y int")
    best = pl.best_feature_thresholds(df, "y", ["s"]).first()
    assert best.accuracy == 1.0 and abs(best.threshold - 0.4) < 0.011
    golden = spark.createDataFrame([("a", "alt"), ("b", "base"), ("c", "abstain"), ("d", "alt")], "id string, golden_label string")
    scored = spark.createDataFrame([("a", 80.0), ("b", 10.0), ("c", 90.0), ("d", None)], "id string, s double")
    got = pl.threshold_accuracy(scored, golden, "s", 70.0).first()
    assert (got.n, round(got.accuracy, 4)) == (3, 0.6667)
