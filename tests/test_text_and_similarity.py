"""Normal forms and similarity kernels by known values and identities."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairloom.functions import similarity as sim
from pairloom.functions import text as tx


def values(spark, rows, expression):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string")
    return [r[1] for r in sorted(df.select("i", expression(F.col("c"))).collect())]


def test_normal_forms(spark):
    assert values(spark, ["+1 (650) 253-0000", None, "", '["+1650","+44"]'], tx.phone_digits) == ["16502530000", "", "", "165044"]
    assert values(spark, ["https://www.A.com/x/", '["https://a.com/"]', None], tx.website) == ["a.com/x", '["https://a.com/"]', ""]
    address = '[{"freeform":"1 Main St","locality":"X","region":null}]'
    assert values(spark, [address, "[]", "null", "5 Oak Ave", None, '{"locality":"X"}'], tx.address_text) == ["1 main street, x", "[]", "null", "5 oak avenue", "", "x"]
    assert values(spark, ["st. louis"], tx.expand_street_words) == ["street. louis"]
    assert values(spark, ['{"x":1}', "[]", '{"primary":', None, '{"primary":"P"}'], tx.primary) == ["", "", "", "", "P"]
    assert values(spark, ['[" https://a "]', "b", None], tx.first_url) == ["https://a", "b", ""]
    assert values(spark, ["+1 650 253 0000", "650-253-0000", "x", None], lambda c: tx.phone_e164(c, F.lit("US"))) == ["+16502530000", "+16502530000", None, None]
    info = values(spark, ['[{"dataset":"Meta","update_time":"2021-01-01T00:00:00.000Z"},{"dataset":"msft","update_time":"bad"}]', "{}", None], tx.sources_info)
    assert (info[0].n, info[0].latest.year, info[0].datasets) == (2, 2021, ["meta", "msft"]) and info[1].n == 0 and info[2].latest is None
    answer = values(spark, ['sure {"name":"Alt","phone":"x","golden_label":"base","reason":"r"} ok', "none at all", None], tx.model_answer)
    assert (answer[0].attr_name_winner, answer[0].attr_phone_winner, answer[0].golden_label, answer[0].slm_reason) == ("alt", "none", "base", "r") and answer[1].golden_label == "abstain"
    assert values(spark, ["<p>a&amp;b</p><script>x</script> c"], tx.html_text) == ["a&b c"]
    page = '<script type="application/ld+json">{"@type":"Cafe","address":{"streetAddress":"1 A St"}}</script><link rel="canonical" href="https://A.com/">'
    assert values(spark, [page], tx.page_category) == ["Cafe"] and values(spark, [page], tx.page_address) == ["1 A St"] and values(spark, [page], lambda c: tx.canonical_url(c, c)) == ["a.com"]


def test_known_similarities(spark):
    pairs = [("Bitezz", "Bitez Mandalina Şenliği", 0.3448275862), ("Hotel&Bugalows El Mirador", "Hotel & Bungalows El Mirador", 0.6415094340), ("KLiA, Kuala Lumpur, Malaysia.", "KLIA", 0.1818181818), ("숙명여자대학교 박물관·미술관", "숙명여자대학교박물관", 0.56)]
    for a, b, want in pairs:
        assert abs(sim.token_sort_of(a, b) / 100 - want) < 1e-9
    assert sim.lcs("kitten", "sitting") == 4 and abs(sim.jaro_winkler_of("MARTHA", "MARHTA") - 0.9611111) < 1e-6
    assert sim.token_set_of("a b", "b a c") == 100.0 and sim.token_set_of("", "x") == 0.0 and sim.partial_of("abc", "xxabcxx") == 100.0
    df = spark.createDataFrame([("a", "a"), ("", ""), ("ab", None), ("abcd", "abce")], "a string, b string")
    assert [r[0] for r in df.select(sim.fuzzy_match(F.col("a"), F.col("b"))).collect()] == [True, True, False, False]
    assert [r[0] for r in df.select(sim.fuzzy_score(F.col("a"), F.col("b"))).collect()][:3] == [1.0, 1.0, 0.0]


@settings(max_examples=200, deadline=None)
@given(st.text("abcd ", max_size=12), st.text("abcd ", max_size=12))
def test_identities(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert sim.lcs(a, b) == table[-1][-1]
    for f in (sim.ratio_of, sim.token_sort_of, sim.token_set_of, sim.partial_of):
        assert f(a, b) == f(b, a) and 0 <= f(a, b) <= 100
    # the best window of the longer side, as long as the shorter one or cut off at an end; it may be below the plain ratio
    short, long = sorted((a, b), key=len)
    every = [sim.ratio_of(short, long[max(0, i) : i + len(short)]) for i in range(1 - len(short), len(long))]
    assert sim.ratio_of(a, a) == 100 and (not short or len(a) == len(b) or abs(sim.partial_of(a, b) - max(every)) < 1e-9)
