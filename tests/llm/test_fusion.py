"""Survivors of duplicates against the rule written out, and planted sources."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from pairloom.functions.jsonx import unwrap_json
from pairloom.llm.fusion import FIELDS, Prior, Sources, claims, duplicates, learn_sources, remaining_text, survivors

SCHEMA = "base_id string, id string, confidence double, sources string, phones string, websites string, addresses string, extra string"


def feeds(spark):
    return spark.createDataFrame([("f1", "UTC", "ymd")], "dataset string, tz_name string, day_order string")


def golden(spark, rows=()):
    return spark.createDataFrame(list(rows), "id string, attr_phone_winner string, attr_address_winner string")


def source(day, name="f1"):
    return json.dumps([{"dataset": name, "update_time": day}]) if day else None


def test_what_counts_as_filled(spark):
    rows = ["[]", "", "  ", "null", "[null]", '[""]', "[{}]", '{"a":null}', '{"a":"x"}', "plain", '["cut', '"[\\"x\\"]"', None, "012", '{"null":" "}', '["a\\nb"]']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string")
    got = [r[1] for r in sorted(df.select("i", remaining_text(unwrap_json(F.col("c"))).isNotNull()).collect())]
    assert got == [False] * 8 + [True, True, False, True, False, True, False, True]


def test_undisputed_against_rule(spark):
    rng = random.Random(3)
    rows, marks = [], []
    for b in range(60):
        for k in range(rng.randrange(1, 5)):
            i = f"{b}-{k}"
            row = (f"b{b}", i, rng.choice([None, 0.1, 0.2, 0.3, float("nan")]), source(rng.choice([None, "2024-01-01", "2024-01-02", "2024-01-03"])), *[rng.choice([None, "[]", f'["{i}"]', '["same"]']) for _ in FIELDS], "z")
            rows += [row] * rng.choice([1, 1, 2])
            if rng.random() < 0.2:
                marks.append((i, rng.choice(["B", " none", "alt", None]), rng.choice(["base", "t"])))
    rows += [(None, "x", 1.0, None, '["1"]', None, None, None), ("bx", None, 1.0, None, '["1"]', None, None, None)]
    dups = duplicates(spark.createDataFrame(rows, SCHEMA), feeds(spark), golden(spark, marks))
    got = {(r.base_id, r.field_name): r.id for r in survivors(dups).filter("is_undisputed").collect()}
    want, told = {}, {i: (p, a) for i, p, a in marks}
    bad = lambda w: (w or "").strip().lower() in ("b", "base", "none")
    for b in {r[0] for r in rows if r[0] and r[1]}:
        mine = {r[1]: r for r in rows if r[0] == b and r[1]}
        if len(mine) < 2:
            continue
        for n, f in enumerate(FIELDS):
            c = {}
            for i, r in mine.items():
                mark = told.get(i, ("alt", "alt"))
                if r[4 + n] in (None, "[]") or (f == "phones" and bad(mark[0])) or (f == "addresses" and bad(mark[1])):
                    continue
                c[i] = (r[3] or "", r[2] if r[2] is not None and r[2] == r[2] else -1)
            for i, (day, conf) in c.items():
                if all(day > d2 and conf > c2 for j, (d2, c2) in c.items() if j != i):
                    want[(b, f)] = i
    assert got == want and len(want) > 20


def test_sources_and_copies(spark):
    rng, rows = random.Random(5), []
    for b in range(300):
        true, wrong = f"t{b}", [f"w{b}{x}" for x in "abc"]
        good = {s: true if rng.random() < 0.9 else rng.choice(wrong) for s in ("s1", "s2", "s3")}
        bad = true if rng.random() < 0.4 else rng.choice(wrong)
        for s, v in {**good, "s4": bad, "s5": bad}.items():
            rows.append((f"b{b}", f"{b}{s}", 0.5, json.dumps([{"dataset": s.upper()}]), None, json.dumps([f"http://{v}.example"]), None, None))
    dups = duplicates(spark.createDataFrame(rows, SCHEMA), feeds(spark), golden(spark))
    model = learn_sources(claims(dups))
    assert min(model.accuracy[s] for s in ("s1", "s2", "s3")) > model.accuracy["s4"] and model.depends[("s4", "s5")] > 0.99 and model.depends[("s1", "s2")] < 0.5
    assert model.votes(("s4", "s5")) < 1.3 * model.votes(("s4",))
    chosen = survivors(dups)
    assert chosen.count() == 300 and chosen.filter("posterior < 0 OR posterior > 1").count() == 0


def test_empty_and_posteriors(spark):
    dups = duplicates(spark.createDataFrame([], SCHEMA), feeds(spark), golden(spark))
    assert survivors(dups).count() == 0
    model = Sources({"a": 0.9}, {})
    assert abs(sum(model.posteriors([(("a",), 1), ((), 10)][:1])) - 0.9) < 1e-9


def test_values_that_say_the_same(spark):
    at = lambda freeform, town="Upton": json.dumps([{"freeform": freeform, "locality": town, "postcode": "AB1 2CD", "country": "GB"}])
    rows = [
        ("p1", '["+49 (0)302/3125455"]', '["https://www.a.example/x/?ref=map"]', at("12345 Harenpl")), ("p2", '["0302 312 5455"]', '["HTTP://a.example/x"]', at("12345 Harenpl", None)),
        ("p3", '["+49 312 312 5455"]', '["http://a.example/y"]', at("12345 Wexweg")), ("p4", '["+1 613 555 0138","+49 302 312 5455"]', '["a.example/x","b.example"]', at("22345 Harenpl")),
        ("p5", '["0049-302-3125455","001-613-5550138"]', '["b.example","a.example/x"]', '["sometime"]'),
    ]
    rows = [("b", i, 0.5, None, p, w, a, a) for i, p, w, a in rows] + [(f"c{n}", f"q{n}", 0.5, None, None, None, at("1 Harenpl"), at("1 Harenpl")) for n in range(9)]
    df = spark.createDataFrame(rows, SCHEMA.replace("extra", "base_addresses"))
    got = {r.id: r for r in duplicates(df, feeds(spark), golden(spark)).collect()}
    classes = lambda f: [[got[f"p{i}"][f].key for i in range(1, 6)].index(got[f"p{k}"][f].key) + 1 for k in range(1, 6)]
    assert classes("phones") == [1, 1, 3, 4, 4] and classes("websites") == [1, 1, 3, 4, 4] and classes("addresses") == [1, 1, 3, 4, 5]


def test_posterior_decides(spark):
    rows = [("b", f"v{k}", 0.5, source("2024-01-01", f"s{k}"), None, '["http://many.example"]', None, None) for k in range(6)]
    rows += [("b", "last", 0.9, source("2024-02-01", "s9"), None, '["http://last.example"]', None, None)]
    rows += [(f"c{n}", f"{n}-{k}", 0.5, source("2024-01-01", f"s{k}"), None, f'["http://{n}.example"]', None, None) for n in range(40) for k in range(6)]
    dups = duplicates(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(f"s{k}", "UTC", "ymd") for k in range(10)], "dataset string, tz_name string, day_order string"), golden(spark))
    told = lambda **p: {r.base_id: (r.id, r.is_undisputed) for r in survivors(dups, Prior(**p)).collect()}
    assert told()["b"] == ("last", True)
    assert told(both=0.0)["b"] == ("v5", False)  # six sources overrule one that is newer and more trusted
    assert not told()["c1"][1]


def test_five_hundred_sources(spark):
    rows = [("b", f"v{k:03d}", 0.5, source("2024-01-01", f"s{k}"), None, '["http://a.example"]' if k < 300 else '["http://z.example"]', None, None) for k in range(500)]
    dups = duplicates(spark.createDataFrame(rows, SCHEMA), feeds(spark), golden(spark))
    got = survivors(dups).collect()
    assert len(got) == 1 and got[0].id == "v299" and 0.99 < got[0].posterior <= 1.0


def test_rounds_of_few_patterns_shuffle_nothing(spark, monkeypatch):
    rows = [(f"b{b}", "websites", v, [f"s{(b * 3 + v + k) % 7}" for k in range(1 + (b + v) % 3)]) for b in range(60) for v in range(2)]
    claimed = spark.createDataFrame(rows, "base_id string, field_name string, key long, voters array<string>")
    context = spark.sparkContext._jsc.sc()
    before = context.newShuffleId()
    model = learn_sources(claimed)
    assert context.newShuffleId() - before <= 6
    monkeypatch.setattr("pairloom.llm.fusion.ONE_TASK", 0)
    spread = learn_sources(claimed)
    assert len(model.accuracy) == 7 and all(abs(a - spread.accuracy[s]) < 1e-9 for s, a in model.accuracy.items())
    assert all(abs(p - spread.depends[k]) < 1e-9 for k, p in model.depends.items()) and len(model.depends) == len(spread.depends)
