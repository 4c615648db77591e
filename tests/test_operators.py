"""Features, truth, metrics, profiles, samples, models, sources and streams on small tables."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from pairloom.operators import features as fe
from pairloom.operators import joins as jn
from pairloom.operators import metrics as me
from pairloom.operators import models as mo
from pairloom.operators import profile as pr
from pairloom.operators import sampling as sa
from pairloom.operators import truth as tr
from pairloom.sources import connectors as co
from pairloom.sources import io
from pairloom.streaming.scoring import RAW_SCHEMA, RecordScorer, score_stream


def raw_rows(n: int = 24):
    out = []
    for i in range(n):
        rich = i % 2 == 0
        side = lambda p, full: (f"{p}{i}", json.dumps([{"dataset": "msft", "update_time": "2024-01-0%dT00:00:00Z" % (1 + i % 9)}]), json.dumps({"primary": f"Cafe {i % 5}"}), json.dumps({"primary": "cafe"}), 0.9 if full else 0.4, json.dumps(["https://a.example/"]) if full else None, "[]", None, json.dumps(["+1 650 253 0000"]) if full else None, None, json.dumps([{"freeform": f"{i} Main St", "locality": f"T{i % 3}", "postcode": None}]))
        out.append((*side("a", rich), *side("b", not rich)))
    return out


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(raw_rows(), RAW_SCHEMA).cache()


@pytest.fixture(scope="module")
def features(raw):
    return fe.engineer_features(fe.prepare_pairs(raw), "2025-01-01").cache()


def test_features(features):
    made = [c for c in features.columns if c.startswith("feat_")]
    assert len(made) == 49 and set(fe.MODEL_FEATURES) < set(made) and len(fe.MODEL_FEATURES) == 46
    r = features.filter("id = 'a0'").first()
    assert (r.feat_match_has_phone, r.feat_base_has_phone, r.feat_phone_exclusive, r.feat_is_msft_match, r.feat_match_recency_days) == (1, 0, 1, 1, 366)
    assert r.feat_name_similarity == 1.0 and r.feat_completeness_delta == 2 and not [c for c in features.columns if c.startswith("_")]
    with pytest.raises(KeyError):
        fe.engineer_features(features.select("id"), "2025-01-01")


def test_truth_without_and_with_source(spark):
    rows = [("1", "12", "12", ""), ("2", "12", "13", ""), ("3", "", "13", ""), ("4", "", "", ""), ("5", "12", "13", "13"), ("6", "12", "13", "99"), ("7", "12", "12", "1-2")]
    df = spark.createDataFrame(rows, "id string, b string, a string, r string")
    done = tr.compared(df, {"phone": F.col("r")}, {"phone": F.col("b")}, {"phone": F.col("a")})
    got = {r.id: (r._phone_winner, r._phone_value) for r in done.collect()}
    assert got == {"1": ("both", "12"), "2": ("base", "12"), "3": ("alt", "13"), "4": ("alt", ""), "5": ("alt", "13"), "6": ("real", "99"), "7": ("both", "12")}
    near = tr.compared(df, {"category": F.lit("coffee shop")}, {"category": F.lit("shop coffee")}, {"category": F.lit("bank")}).first()
    assert (near._category_winner, near._category_value) == ("base", "shop coffee")


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([("alt", "alt", 0.9, 1), ("alt", "base", 0.4, 1), ("base", "base", 0.4, 0), ("both", "alt", 0.2, 0)], "t string, p string, s double, y int")
    m = me.class_metrics(df, "t", "p", ("alt", "base", "both")).first()
    assert (m.n, m.accuracy, m.f1_alt, m.f1_both) == (4, 0.5, 0.5, 0.0) and abs(m.macro_f1 - (0.5 + 2 / 3) / 3) < 1e-9
    assert me.binary_metrics(df, "t", "p").first().asDict()["tn"] == 1
    assert me.roc_auc(df, "s", "y").first().auc == 0.875
    sweep = {r.threshold: r.accuracy for r in me.threshold_sweep(df, "s", "y", [0.3, 0.5]).collect()}
    assert sweep == {0.3: 0.75, 0.5: 0.75} and me.best_threshold(me.threshold_sweep(df, "s", "y", [0.3, 0.5]), "accuracy").first().threshold == 0.3
    curve = {r.threshold: (r.precision, r.recall) for r in me.precision_recall_curve(df, "s", "y").collect()}
    assert curve[0.9] == (1.0, 0.5) and curve[0.2] == (0.5, 1.0)


def test_profiles(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), (None, 3.0)], "k string, x double")
    assert {r.column: r.n_null for r in pr.null_profile(df).collect()} == {"k": 1, "x": 1}
    assert pr.null_profile(df.limit(0)).count() == 2
    assert {r.column: r.n_distinct for r in pr.distinct_counts(df, ["k"], True).collect()} == {"k": 2}
    assert pr.mean_drift(df, df.filter("x > 1"), ["x"]).first().drifted
    assert pr.shared_key(df.withColumn("some_id", F.lit(1)), df.withColumn("some_id", F.lit(1))) == "some_id"


def test_samples_and_joins(spark, raw):
    same = lambda f: sorted(map(tuple, f().collect())) == sorted(map(tuple, f().collect()))
    assert same(lambda: sa.random_negatives(raw, 10)) and sa.random_negatives(raw, 10).filter("id = base_id").count() == 0
    hard = sa.hard_negatives(raw).collect()
    assert hard and len({r.name for r in hard}) == len(hard)
    folds = sa.stratified_folds(raw.withColumn("y", F.col("confidence") > 0.5), "id", "y", 3, slices=1).groupBy("y", "fold").count().collect()
    assert max(r["count"] for r in folds) - min(r["count"] for r in folds) <= 1
    assert sa.first_per_key(raw.select("names", "id"), ["names"], ["id"]).count() == 5
    a, b = spark.createDataFrame([("1", "x"), ("1", "y")], "id string, v string"), spark.createDataFrame([("1", "z")], "id string, v string")
    assert jn.with_suffixes(a, b, "id").columns == ["id", "v", "v_pred"] and jn.with_suffixes(a, b, "id").count() == 2
    golden = spark.createDataFrame([(str(i), *["both"] * 5, "n", "m") for i in range(8)], "id string, " + ", ".join(f"attr_{x}_winner string" for x in ("name", "phone", "web", "address", "category")) + ", names string, base_names string")
    made = sa.synthetic_labels(golden, n_none=2)
    assert made.count() == 16 and {r["4class_testlabels"] for r in made.collect()} >= {"alt", "both", "none"}


def test_models_and_scorer(spark, raw, features, tmp_path):
    label = F.when(F.col("confidence") > 0.5, "alt").otherwise("base")
    names = ["feat_phone_presence_delta", "feat_existence_conf_delta", "feat_not_there"]
    for classifier in (mo.logistic(), mo.forest(5, 3), mo.boosted(rounds=3), mo.stump()):
        model = mo.fit(features, names, label, ("base", "alt"), classifier)
        done = mo.predict(model, features, names, ("base", "alt"), "m").withColumn("want", label)
        assert done.filter("m_pred = want").count() == 24 and abs(done.first()["m_proba_alt"] + done.first()["m_proba_base"] - 1) < 1e-6
    model = mo.fit(features, names[:2], label, ("alt", "base", "both"), mo.forest(5, 3))
    record = dict(zip([f.split()[0] for f in RAW_SCHEMA.split(", ")], raw_rows(1)[0], strict=True))
    scorer = RecordScorer(spark, model, names[:2], "2025-01-01")
    assert scorer.predict(record)["prediction"] == "alt"
    with pytest.raises(KeyError):
        scorer.predict({"id": "x"})
    raw.write.parquet(str(tmp_path / "in"))
    score_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), model, names[:2], "2025-01-01").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 24


def test_model_queries_are_whole(spark):
    from pairloom.plans import q_tables as q

    assert tuple(q.FEATURES) == fe.MODEL_FEATURES and q.FOREST == {"trees": 200, "depth": 12} and q.BOOSTED == {"rounds": 150, "rate": 0.05}
    df = spark.createDataFrame([(0.0, "base")] * 30 + [(0.0, "alt")] * 10 + [(1.0, "alt")] * 5, "x double, y string")
    rows = df.withColumn("_label", F.when(F.col("y") == "alt", 1.0).otherwise(0.0))
    assert mo.balanced(rows, ("base", "alt")) == {"base": 45 / 60, "alt": 45 / 30} and mo.balanced(rows, ("base", "alt"), 1.0)["alt"] == 1.0
    at = lambda weights: mo.predict(mo.fit(df, ["x"], F.col("y"), ("base", "alt"), mo.stump(), weights=weights), df.limit(1), ["x"], ("base", "alt"), "m").first()["m_proba_alt"]
    assert abs(at(None) - 0.25) < 1e-9 and abs(at({"alt": 3.0}) - 0.5) < 1e-9 and abs(at("balanced") - 0.4) < 1e-9


def test_neighbours_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    points = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(i, [float(x) for x in p], i % 2) for i, p in enumerate(points)], "k int, v array<double>, y int").repartition(5)
    got = {r.k: (r.mean_label, r.nearest) for r in mo.nearest_neighbours(df.filter("k % 20 = 0"), df, "k", "v", "y", 5).collect()}
    for i in (0, 20, 40):
        d = np.linalg.norm(points - points[i], axis=1)
        order = [j for j in np.argsort(d) if j != i][:5]
        assert got[i] == (sum(j % 2 for j in order) / 5, order[0])


def test_sources_and_connectors(spark, tmp_path):
    df = spark.createDataFrame([("1", "https://a.example"), ("2", "http://b.example"), ("3", "")], "id string, url string")
    calls = []

    def check(values):
        calls.append(sorted(r.value for r in values.collect()))
        return values.select("value", F.lit(True).alias("valid"), F.lit("ok").alias("reason"))

    first, fresh = io.memoised(df, "website", "url", None, check)
    assert {r.id: r.valid for r in first.collect()} == {"1": True, "2": True, "3": False}
    io.memoised(df, "website", "url", fresh, check)[0].collect()
    assert calls == [["http://b.example", "https://a.example"], []]
    fetch = lambda url: (200, "Cafe Rosa") if url == "https://b.example" else (500, "")
    told = {r.id: r.site_valid for r in co.verify_websites(df.withColumn("name", F.lit("Rosa")), "url", fetch, "name").collect()}
    assert told == {"1": False, "2": True, "3": False}
    done = co.label_with(df.withColumn("prompt", F.col("url")), "id", "prompt", lambda p: '{"name":"alt"}', df.filter("id = '1'"))
    assert {r.id: r.attr_name_winner for r in done.collect()} == {"2": "alt", "3": "alt"}
    tries = []
    assert co.with_retries(lambda v: tries.append(v) or 1 / 0, 3, 0.0, lambda s: None)("x") is None and len(tries) == 3
    io.write_csv(df, str(tmp_path / "c"))
    assert io.read_csv(spark, str(tmp_path / "c")).count() == 3
    io.write_report(str(tmp_path / "r.md"), {"All": df})
    assert "| id | url |" in (tmp_path / "r.md").read_text()
    env = tmp_path / "env"
    env.write_text("# c\nA_KEY = 'x'\n\nbad\n")
    assert io.settings_from(str(env)) == {"A_KEY": "x"}
    assert io.run_all([("t", str(tmp_path / "r.md"), lambda: 1 / 0), ("u", str(tmp_path / "none"), lambda: 1 / 0)], str(env))["u"].startswith("failed")
