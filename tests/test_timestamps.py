"""Instants from mixed spellings."""

from __future__ import annotations

import datetime as dt

import pytest

from pairloom.functions.timestamps import with_instants
from pairloom.operators.entries import source_instants

FEEDS = [("east", "America/New_York", "mdy"), ("mitte", "Europe/Berlin", "dmy"), ("plain", "UTC", "ymd"), ("nowhere", None, None)]


def us(*parts: int, micro: int = 0) -> int:
    at = dt.datetime(*parts, tzinfo=dt.UTC) - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)
    return at // dt.timedelta(microseconds=1) + micro


CASES = [
    ("2021-03-04T05:06:07Z", "plain", us(2021, 3, 4, 5, 6, 7)),
    ("2021-03-04 05:06:07.1234567Z", "plain", us(2021, 3, 4, 5, 6, 7, micro=123456)),
    ("  2021-03-04T05:06:07+02:00 ", "plain", us(2021, 3, 4, 3, 6, 7)),
    ("2021-03-04T05:06:07,5-0330", "plain", us(2021, 3, 4, 8, 36, 7, micro=500000)),
    ("2021-03-04T05:06:07+08", "plain", us(2021, 3, 3, 21, 6, 7)),
    ("20210304T050607Z", "plain", us(2021, 3, 4, 5, 6, 7)),
    ("20210304", "mitte", us(2021, 3, 3, 23)),
    ("1612282965", "mitte", us(2021, 2, 2, 16, 22, 45)),
    ("1612282965242", "mitte", us(2021, 2, 2, 16, 22, 45, micro=242000)),
    ("04.03.2021 05:06:07", "mitte", us(2021, 3, 4, 4, 6, 7)),
    ("Thu, 04 Mar 2021 05:06:07 +0100", "plain", us(2021, 3, 4, 4, 6, 7)),
    ("04-Mar-2021 05:06:07", "plain", us(2021, 3, 4, 5, 6, 7)),
    ("Mar 4, 2021 05:06:07", "plain", us(2021, 3, 4, 5, 6, 7)),
    ("03/04/2021 12:06 AM", "EAST", us(2021, 3, 4, 5, 6)),
    ("03/04/2021 12:06", "mitte", us(2021, 4, 3, 10, 6)),
    ("2021/03/04 1:06 PM", "plain", us(2021, 3, 4, 13, 6)),
    ("2021-07-04 05:06:07 EDT", "plain", us(2021, 7, 4, 9, 6, 7)),
    ("2021-07-04T05:06:07[Europe/Berlin]", "plain", us(2021, 7, 4, 3, 6, 7)),
    ("2021-11-07 01:30:00", "east", us(2021, 11, 7, 5, 30)),  # occurs twice: the first
    ("2021-03-14 02:30:00", "east", us(2021, 3, 14, 7, 30)),  # skipped: the offset before
    ("2024-02-29", "plain", us(2024, 2, 29)),
    ("2023-02-29", "plain", None), ("2025-06-31 09:15:00", "plain", None), ("2021-13-01", "plain", None), ("2021-03-04 25:00:00", "plain", None),
    ("03/04/2021 13:06 PM", "east", None), ("03/04/2021 01:00", "plain", None), ("2021-03-04T05:06:07[Mars/Base]", "plain", None), ("2021-03-04 05:06:07 XYZ", "plain", None),
    ("2021-03-04 05:06:07", "nowhere", None), ("2021-03-04 05:06:07", "unknown", None), ("unknown", "plain", None), ("", "plain", None), (None, "plain", None), ("x" * 50_000, "plain", None),
]


@pytest.fixture(scope="module")
def feeds(spark):
    return spark.createDataFrame(FEEDS, "dataset string, tz_name string, day_order string")


def test_every_spelling(spark, feeds):
    rows = spark.createDataFrame([(i, t, f) for i, (t, f, _) in enumerate(CASES)], "i int, written string, feed string")
    got = {r.i: r.epoch_us for r in with_instants(rows, "written", "feed", feeds).collect()}
    assert {CASES[i][:2]: got[i] for i in got} == {c[:2]: c[2] for c in CASES}


def test_entries_keep_position_and_drop_canonical(spark, feeds):
    sources = '[{"dataset":"plain","update_time":"2021-03-04T05:06:07Z"},null,{"dataset":"plain","update_time":"2021-03-04"}]'
    rows = [("a", sources), ("a", sources), ("b", '{"dataset":"plain","update_time":20210305}'), ("c", '[{"dataset":"pl'), ("d", None), (None, sources), ("e", '"[{\\"dataset\\":\\"plain\\",\\"update_time\\":\\"1612282965\\"}]"'), ("f", "")]
    df = spark.createDataFrame(rows, "id string, sources string")
    got = sorted(map(tuple, source_instants(df, feeds, {"id": "sources"}, keep_canonical=False).collect()))
    assert got == [("a", 2, us(2021, 3, 4)), ("b", 0, us(2021, 3, 5)), ("e", 0, us(2021, 2, 2, 16, 22, 45))]


def test_clashing_columns_and_empty_table(spark, feeds):
    df = spark.createDataFrame([], "written string, feed string, y int, epoch_ms long")
    out = with_instants(df, "written", "feed", feeds)
    assert out.columns == ["written", "feed", "y", "epoch_ms", "epoch_us"] and out.count() == 0
