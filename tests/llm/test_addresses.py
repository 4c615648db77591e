"""Addresses: parsing, mined rewrites, misspellings and pairs at one location."""

from __future__ import annotations

import json
import random

from pairloom.llm.addresses import located_pairs, parse_all, places_of_rows, same_location

SCHEMA = "id string, addresses string, base_id string, base_addresses string, number string"


def parsed(text):
    return parse_all(text)[0][:3] if parse_all(text) else None


def test_parsing():
    box = lambda f, town="X": json.dumps([{"freeform": f, "locality": town, "country": "US"}])
    assert parsed(box("Floor 13, 153 Shilrow St."))[:2] == ("153", "shilrow st")
    assert parsed(box("Camino Fennías, 114 b"))[:2] == ("114b", "camino fennias")
    assert parsed(box("241 c Kestwick Street")) [:2] == ("241c", "kestwick street")
    assert parsed(box("46 E Dunnrow Drive"))[:2] == ("46", "e dunnrow drive")
    assert parsed(box("222B 9th Street, #4"))[:2] == ("222b", "9th street")
    assert parsed(box("Praça Gildandia, nº 222, próximo à feira"))[:2] == ("222", "praca gildandia")
    assert parsed("120 Schilingham Terrace, RAMOMSTEAD FA1 6XQ, GB") == ("120", "schilingham terrace", "ramomstead")
    assert parse_all("120 Schilingham Terrace, RAMOMSTEAD FA1 6XQ, GB")[0][4:] == ("fa16xq", "gb")
    assert parse_all('"[{\\"freeform\\":\\"1 Oak St\\"}]"')[0][:2] == ("1", "oak st")
    for nothing in (None, "", "[]", '[{"freeform":"1 A', "null", "[null]"):
        assert parse_all(nothing) == []
    assert parse_all("x " * 30_000)[0][0] == ""


def town(spark, seed=2, copies=6):
    """Places with streets written in two ways, and one misspelt."""
    rng, rows = random.Random(seed), []
    names = ["Alder", "Birch", "Cedar", "Damson", "Elmwood", "Fernhill", "Gorsemoor", "Hazelden"]
    for n in range(160):
        name, kind = rng.choice(names), rng.choice([("Street", "St."), ("Road", "Rd"), ("Lane", "Ln")])
        number = 1 + n
        a, b = (json.dumps([{"freeform": f"{number} {name} {rng.choice(kind)}", "locality": "Upton", "postcode": "AB1 2CD", "country": "GB"}]) for _ in "ab")
        rows.append((f"a{n}", a, f"b{n}", b, "z"))
    odd = [("m1", "7 Gorsmeoor Road", "m2", "7 Gorsemoor Rd"), ("x1", "9 Alder Street", "x2", "9 Alder Lane"), ("y1", "9 Alder St", "y2", "11 Alder St")]
    rows += [(i, json.dumps([{"freeform": f, "locality": "Upton", "country": "GB"}]), j, json.dumps([{"freeform": g, "postcode": "AB12CD", "country": "UK"}]), "z") for i, f, j, g in odd]
    rows += [("n1", None, "n2", "", "z"), ("n3", "[{}]", "n4", '["cut', "z"), (None, rows[0][1], None, None, "z")]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_mined_rewrites_join_locations(spark):
    found = {r.a_id: r for r in located_pairs(town(spark), ("id", "addresses"), ("base_id", "base_addresses")).collect()}
    joined = [found[f"a{n}"].a_location == found[f"a{n}"].b_location for n in range(160)]
    assert sum(joined) == 160
    assert found["m1"].a_location == found["m1"].b_location
    assert found["x1"].a_location != found["x1"].b_location and found["y1"].a_location != found["y1"].b_location
    assert found["n3"].a_location is None if "n3" in found else True


def test_pairs_are_ordered_and_distinct(spark):
    located = spark.createDataFrame([("p", "q", "t/1/s", "t/1/s"), ("p", "q", "t/1/s", "t/1/s"), ("r", "p", None, "t/1/s"), ("q", "q", "t/1/s", "t/1/s"), (None, "z", "t/1/s", "t/2/s")], "a_id string, b_id string, a_location string, b_location string")
    assert sorted(map(tuple, same_location(places_of_rows(located)).collect())) == [("p", "q")]
    assert same_location(places_of_rows(located.limit(0))).count() == 0


def test_empty_table(spark):
    assert located_pairs(spark.createDataFrame([], SCHEMA), ("id", "addresses"), ("base_id", "base_addresses")).count() == 0


def test_normalised_locations(spark):
    from pairloom.llm.q_addresses import normalised_locations

    assert parse_all("150, avenue marloux, peningny, nor, 01029, fr")[0] == ("150", "avenue marloux", "peningny", "nor", "01029", "fr")
    assert parse_all("calle lororeda, 162-a, helanilla, court, 01016, es")[0] == ("162a", "calle lororeda", "helanilla", "ct", "01016", "es")
    rows = [(f"a{n}", f"{n + 1} alder street, upton, eng, ab1 2cd, gb", f"b{n}", f"{n + 1} alder road, upton, eng, ab1 2cd, gb" if n % 20 == 0 else f"{n + 1} alder street, upton, eng, ab1 2cd, uk") for n in range(40)]
    rows += [(f"c{n}", f"{n + 1} alder street, newby, eng, xy9 8zw, gb", f"d{n}", f"flat 2, {n + 1} alder street, newby, eng, xy9 8zw, gb") for n in range(20)] + [rows[1], (None, "[]", None, "null")]
    got = {r.location: (r.n_places, r.first_place, r.n_agreeing) for r in normalised_locations(spark.createDataFrame(rows, "id string, norm_conflated_addr string, base_id string, norm_base_addr string")).collect()}
    assert got["upton|gb/2/alderstreet"] == (2, "a1", 1) and got["newby|gb/2/alderstreet"] == (2, "c1", 1)
    assert got["upton|gb/1/alderstreet"] == (1, "a0", 0) and got["upton|gb/1/alderroad"] == (1, "b0", 0) and len(got) == 62


def test_mining_ends_when_nothing_is_new(spark):
    from pairloom.llm.addresses import mine_rewrites

    rows = [("gb", "x0 z", "xx0 z", 5), ("gb", "xx0 z", "xx0 z", 20)]
    for k in range(5):  # each pair shows its second word only after its first is rewritten
        rows += [("gb", f"x{k} y{k}", f"xx{k} yy{k}", 5), ("gb", f"x{k + 1} y{k}", f"xx{k + 1} yy{k}", 5), ("gb", f"xx{k} yy{k}", f"xx{k} yy{k}", 20), ("gb", f"xx{k + 1} yy{k}", f"xx{k + 1} yy{k}", 20)]
    got = mine_rewrites(spark.createDataFrame(rows, "country string, a_street string, b_street string, n long"))
    assert got == {("gb", "f", f"x{k}"): f"xx{k}" for k in range(6)} | {("gb", "l", f"y{k}"): f"yy{k}" for k in range(5)}


def test_towns_against_rule(spark):
    """Countries and towns from small and from large gazetteers against the rule written out."""
    from collections import Counter

    from pairloom.llm.addresses import LOOKUPS, with_towns

    rng, rows = random.Random(4), []
    for k in range(400):
        some = lambda *x: rng.choice(["", *x])
        rows.append((k, k, some("alder st", "birch rd", "cedar ln"), some("upton", "newby", "hamm"), some("e", "w"), some("11111", "22222", "ab12cd"), some("gb", "gb", "us", "de"), rng.randrange(1, 6)))
    names = ("k1", "k2", "street", "name", "region", "postcode", "country", "n")
    made = [dict(zip(names, r, strict=True)) for r in rows]
    for m in made:
        m |= {"head": m["street"].split(" ")[0], "tail": m["street"][-3:]}
    told = [dict(m) for m in made if m["country"]]
    known = Counter()
    for m in told:
        known[m["country"], m["name"]] += m["n"] * bool(m["name"])
    want = {m["k1"]: m for m in made}
    for keys, value, share in LOOKUPS:
        counts: dict[tuple, Counter] = {}
        for m in told:
            if m[value] and all(m[k] for k in keys):
                counts.setdefault(tuple(m[k] for k in keys), Counter())[m[value]] += m["n"]
        for m in want.values():
            c = counts.get(tuple(m[k] for k in keys), Counter())
            best, n = max(((v, n) for v, n in c.items()), key=lambda x: (x[1], x[0]), default=("", 0))
            found = best if n >= share * sum(c.values()) else ""
            if value == "country":
                m["country"] = m["country"] or found
            else:
                m["guess"] = found
    town = lambda m: m["name"] if m["name"] and known[m["country"], m["name"]] >= 3 else m["guess"] or m["name"]
    want = {k: (m["country"], f"{town(m)}|{m['country']}" if town(m) else "") for k, m in want.items()}
    mentions = spark.createDataFrame(rows, "k1 long, k2 long, street string, name string, region string, postcode string, country string, n long")
    for most in (200_000, 0):
        assert {r.k1: (r.country, r.town) for r in with_towns(mentions, most).collect()} == want
    assert len({t for _, t in want.values()}) > 5 and any(c and not r[6] for r, (c, _) in zip(rows, want.values(), strict=True))


def test_few_shuffles(spark):
    """Every shuffle is a plan and a thread of the driver, whatever the size of the table."""
    from pairloom.llm.addresses import located

    context = spark.sparkContext._jsc.sc()
    before = context.newShuffleId()
    assert located(town(spark), ("id", "addresses"), ("base_id", "base_addresses")).said().count() > 160
    assert context.newShuffleId() - before <= 50
