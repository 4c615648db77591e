"""Packing and mixing by token budgets."""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm.mixing import mix, share_out, tree
from pairloom.llm.packing import boundaries, bucket_only, pack, plan
from pairloom.llm.tokens import VOCABULARY, encoding, with_token_counts


def test_boundaries_are_optimal():
    lengths, counts = np.array([1, 3, 4, 7, 9, 12]), np.array([5, 1, 7, 2, 9, 1])
    padding = lambda ends: sum(c * (min(e for e in ends if e >= x) - x) for x, c in zip(lengths, counts, strict=True))
    for b in (1, 2, 3, 4, 9):
        best = min(padding(e) for k in range(1, b + 1) for e in itertools.combinations(lengths, min(k, 6)) if 12 in e)
        assert padding(boundaries(lengths, counts, b)) == best


def test_plan_holds_every_piece():
    rng = np.random.default_rng(1)
    lengths = np.arange(1, 65)
    counts = rng.integers(0, 30, 64)
    p = plan(lengths[counts > 0], counts[counts > 0], 64, 16)
    used = (lengths * counts).sum() / (p.n_containers * 64)
    assert used > 0.9 and bucket_only(lengths[counts > 0], counts[counts > 0], 64, 16) >= p.n_containers


def test_packing_whole_texts(spark):
    rng = np.random.default_rng(2)
    sizes = [int(x) for x in rng.integers(0, 90, 500)] + [200, 250, 50, 100]
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)] + [(None, 5, "x")], "doc_id long, n_tokens long, bucket string").repartition(6)
    rows = pack(df, "doc_id", "n_tokens", {"small": 50, "large": 100}, slice_rows=7).collect()
    for name, capacity in (("small", 50), ("large", 100)):
        mine = [r for r in rows if r.pack_name == name]
        fill, got = Counter(), Counter()
        for r in mine:
            fill[r.container_no] += r.n_tokens
            got[r.doc_id] += r.n_tokens
        assert max(fill.values()) <= capacity and got == Counter({i: n for i, n in enumerate(sizes)} | {None: 5}) or got[None] == 5
        parts = defaultdict(list)
        for r in mine:
            parts[r.doc_id].append((r.part_no, r.start_token, r.n_tokens))
        for i, n in enumerate(sizes):
            assert len(parts[i]) == max(1, -(-n // capacity)) and sorted(parts[i])[0][1] == 0
        assert sum(fill.values()) / (capacity * len(fill)) > 0.9
    assert pack(df.limit(0), "doc_id", "n_tokens", {"small": 50}).count() == 0


def test_shortage_goes_to_siblings_first():
    root = tree([("d", "en", "a", 0.4, 10.0), ("d", "en", "b", 0.2, 100.0), ("d", "de", "c", 0.4, 100.0)])
    out: dict[str, float] = {}
    share_out(root, 100.0, out)
    assert {k: round(v, 6) for k, v in out.items()} == {"d/en/a": 10.0, "d/en/b": 50.0, "d/de/c": 40.0}
    share_out(root, 180.0, out)
    assert out["d/en/a"] == 10.0 and abs(sum(out.values()) - 180.0) < 1e-6


def docs(spark, n=4_000):
    rows = [(i, ("A " if i % 3 == 0 else "b" if i % 3 == 1 else "c") if i % 50 else None, "en-GB" if i % 2 else "de", 1 + i % 17) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_tokens long").withColumn("domain", F.lit("x")).repartition(5)


def test_mix_meets_shares_and_caps(spark):
    targets = spark.createDataFrame([("a", 0.6, 2), ("B", 0.3, 1), ("absent", 0.1, 3)], "source string, target_share double, max_repeats int")
    repeats, shares, leaves = mix(docs(spark), targets, total=30_000)
    told = {r.source: r for r in shares.collect()}
    rows = repeats.collect()
    assert len(rows) == 4_000 and {r.repeats for r in rows if r.source in ("c", None)} == {0}
    assert max(r.repeats for r in rows if r.source == "a") <= 2 and max(r.repeats for r in rows if r.source == "b") <= 1
    for s in ("a", "b"):
        assert abs(told[s].tokens_taken - told[s].budget) <= 17
    by_leaf = leaves.collect()
    assert {(r.domain, r.lang, r.source) for r in by_leaf} == {("x", lang, s) for lang in ("en", "de") for s in "ab"} and all(abs(r.budget - r.tokens_taken) <= 9 for r in by_leaf)
    assert told["absent"].tokens_taken == 0 and abs(sum(r.actual_share for r in told.values()) - 1) < 1e-9
    again = {r.doc_id: r.repeats for r in mix(docs(spark).repartition(3), targets, total=30_000)[0].collect()}
    assert again == {r.doc_id: r.repeats for r in rows}
    for small in (10, 100):
        assert again == {r.doc_id: r.repeats for r in mix(docs(spark), targets, total=30_000, small=small)[0].collect()}
    largest = {r.source: r for r in mix(docs(spark), targets.filter("source <> 'absent'"))[1].collect()}
    assert abs(largest["a"].actual_share - 2 / 3) < 0.01
    assert mix(docs(spark).limit(0), targets)[0].count() == 0


def test_a_short_leaf_is_made_up_by_its_siblings(spark):
    rows = [(i, s, lang, 10) for i, (s, lang) in enumerate([("a", "en")] * 10 + [("b", "en")] * 100 + [("a", "de")] * 10 + [("c", "de")] * 100)]
    records = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_tokens long").withColumn("domain", F.lit("x"))
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.25, 1), ("c", 0.25, 1)], "source string, target_share double, max_repeats int")
    got = {(r.lang, r.source): (r.budget, r.tokens_taken) for r in mix(records, targets, total=1_000)[2].collect()}
    # each language keeps its half: what a lacks there goes to its one sibling
    assert got == {("en", "a"): (100.0, 100), ("en", "b"): (400.0, 400), ("de", "a"): (100.0, 100), ("de", "c"): (400.0, 400)}
    filled = {(r.lang, r.source): r.budget for r in mix(records, targets, fill=1.0)[2].collect()}
    assert sum(filled.values()) == 2_200.0


def test_token_counts(spark):
    text = "Hello, wörld! " * 3_000
    df = spark.createDataFrame([(1, "Hello"), (2, None), (3, ""), (4, text)], "i int, t string")
    got = {r.i: r.n_tokens for r in with_token_counts(df, "t").collect()}
    with open(VOCABULARY, "rb") as file:
        encoder = encoding(file.read())
    assert got[1] == 1 and got[2] == got[3] == 0 and got[4] == len(encoder.encode_ordinary(text)) and encoder.decode(encoder.encode_ordinary(text)) == text
    with pytest.raises(OSError):
        with_token_counts(df, "t", vocabulary="/nowhere")
