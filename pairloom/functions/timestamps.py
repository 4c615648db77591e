"""Timestamps in many spellings, made into microseconds since 1970 UTC.

Every format is one arm of a single regular expression with named groups. One ``regexp_replace`` per value copies
the groups of the arm that matched into fixed slots, calendar ranges are checked on the integers, and the instant is
put together by integer day arithmetic. Everything is a built-in expression, so it stays in generated code.

Defined results: NULL, empty or unknown spellings, impossible dates, unknown zones and times without a zone from a
feed without a zone all give NULL. Repeated local times are the first of the two, skipped ones are read with the
offset before the change. Digits finer than a microsecond are cut off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.session import bounded_rows

#: Offsets in minutes of zone abbreviations.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "SAST": 120, "IST": 330, "NPT": 345, "SGT": 480, "HKT": 480, "AWST": 480, "JST": 540, "KST": 540, "ACST": 570, "ACDT": 630,
    "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "BRT": -180, "BRST": -120, "ART": -180, "NST": -210, "NDT": -150,
    "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480,
    "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}

#: Months by the first letters of their names.
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}

_MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
_TIME = r"(?<h{n}>\d{{1,2}}):(?<mi{n}>\d{{2}})(?::(?<s{n}>\d{{2}})(?:[.,](?<f{n}>\d+))?)?"
_ZONE = r"\s*(?<z{n}>z|[+-]\d{{2}}(?::?\d{{2}})?|\[[a-z0-9_+/-]+\]|[a-z]{{3,4}})?"
_HALF = r"(?:\s*(?<ap{n}>[ap])\.?m\.?)"

#: The formats; {n} makes the group names of each arm its own.
FORMATS = [
    r"(?<y{n}>\d{{4}})-(?<mo{n}>\d{{1,2}})-(?<d{n}>\d{{1,2}})(?:(?:\s*t|\s+)" + _TIME + _ZONE + ")?",
    r"(?<y{n}>\d{{4}})(?<mo{n}>\d{{2}})(?<d{n}>\d{{2}})(?:t(?<h{n}>\d{{2}})(?<mi{n}>\d{{2}})(?<s{n}>\d{{2}})?" + _ZONE + ")?",
    r"(?<e{n}>\d{{9,10}}|\d{{12,13}}|\d{{15,16}})",
    r"(?<d{n}>\d{{1,2}})\.(?<mo{n}>\d{{1,2}})\.(?<y{n}>\d{{4}})(?:,?\s+" + _TIME + _ZONE + ")?",
    r"(?:[a-z]{{3,9}},\s*)?(?<d{n}>\d{{1,2}})[\s-](?<mon{n}>" + _MONTH + r")\.?[\s-](?<y{n}>\d{{4}})(?:,?\s+" + _TIME + _HALF + "?" + _ZONE + ")?",
    r"(?<mon{n}>" + _MONTH + r")\.?\s+(?<d{n}>\d{{1,2}}),?\s+(?<y{n}>\d{{4}})(?:,?\s+" + _TIME + _HALF + "?" + _ZONE + ")?",
    r"(?<y{n}>\d{{4}})/(?<mo{n}>\d{{1,2}})/(?<d{n}>\d{{1,2}})(?:,?\s+" + _TIME + _HALF + "?" + _ZONE + ")?",
    r"(?<a{n}>\d{{1,2}})/(?<b{n}>\d{{1,2}})/(?<y{n}>\d{{4}})(?:,?\s+" + _TIME + _HALF + "?" + _ZONE + ")?",
]

_SLOTS = ("y", "mo", "mon", "d", "a", "b", "h", "mi", "s", "f", "ap", "z", "e")
_MARK = "\u0001"

#: What is already in the one unambiguous form.
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"


def _compiled() -> tuple[str, str]:
    """The alternation and the replacement that copies its groups into slots."""
    arms = [arm.format(n=f"x{i}") for i, arm in enumerate(FORMATS)]
    pattern = r"(?is)^[\s\p{Z}]*(?:" + "|".join(arms) + r")[\s\p{Z}]*$"
    slots = ["".join(f"${{{slot}x{i}}}" for i, arm in enumerate(arms) if f"(?<{slot}x{i}>" in arm) for slot in _SLOTS]
    return pattern, _MARK.join(slots)


def zone_names(spark: SparkSession) -> list[str]:
    """The region names the JVM's zone rules know."""
    found = spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds().toArray()
    return sorted(x for x in found if "/" in x or x in ("UTC", "GMT"))


def feed_maps(feeds: DataFrame, limit: int = 10_000) -> tuple[dict[str, str], dict[str, str]]:
    """Zone and day order by lower-case feed name; the table is checked to have at most ``limit`` rows."""
    rows = bounded_rows(feeds.select("dataset", "tz_name", "day_order"), limit, "feed_zones")
    named = [r for r in rows if r.dataset is not None]
    zones = {r.dataset.strip().lower(): r.tz_name for r in named if r.tz_name}
    return zones, {r.dataset.strip().lower(): r.day_order.lower() for r in named if r.day_order}


def _lookup(values: dict[str, object], key: Column, kind: str) -> Column:
    if not values:
        return F.lit(None).cast(kind)
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, by integers alone; years from 0 on."""
    def div(a: Column, b: int) -> Column:
        return F.call_function("div", a.cast("bigint"), F.lit(b).cast("bigint"))  # no operand is negative for years from 0 on

    shifted = y - F.when(m <= 2, 1).otherwise(0)
    era = div(shifted, 400)
    yoe = shifted - era * 400
    doy = div(F.lit(153) * (m + F.when(m > 2, -3).otherwise(9)) + 2, 5) + d - 1
    doe = yoe * 365 + div(yoe, 4) - div(yoe, 100) + doy
    return era * 146_097 + doe - 719_468


def _month_length(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def with_instants(df: DataFrame, text: str, feed: str, feeds: DataFrame, into: str = "epoch_us", keep_canonical: bool = True, drop_missing: bool = False) -> DataFrame:
    """Add ``into``, the microseconds since 1970 UTC that column ``text`` of feed ``feed`` denotes.

    With ``keep_canonical=False`` rows already written ``YYYY-MM-DDThh:mm:ss[.f]Z`` are left out before parsing.
    With ``drop_missing`` rows that denote no instant are left out; they go by way of an exploded array, as the
    optimizer would push a filter on the result below every stage and write its whole expression out many times.
    Columns of ``df`` are kept; the working columns have names of their own.
    """
    zones, orders = feed_maps(feeds)
    names = zone_names(df.sparkSession)
    if not keep_canonical:
        df = df.filter(~F.regexp_like(F.col(text), F.lit(CANONICAL)))
    pattern, slots = _compiled()
    kept = df.columns
    w = "__ts_"
    at = lambda x: F.col(w + x)
    df = df.select("*", F.split(F.regexp_replace(F.col(text).cast("string"), pattern, slots), _MARK).alias(w + "p"))
    df = df.filter(F.size(w + "p") == len(_SLOTS)) if not keep_canonical else df.withColumn(w + "p", F.when(F.size(w + "p") == len(_SLOTS), F.col(w + "p")))
    feed_name = F.lower(F.trim(F.col(feed)))
    df = df.select(*kept, *[F.get(w + "p", F.lit(i)).alias(w + slot) for i, slot in enumerate(_SLOTS)], _lookup(orders, feed_name, "string").alias(w + "order"), _lookup({k: v for k, v in zones.items() if v in names}, feed_name, "string").alias(w + "feed"))
    month = F.coalesce(at("mo").try_cast("int"), _lookup(MONTHS, F.lower(F.substring(at("mon"), 1, 3)), "int"))
    first, second, zone = at("a").try_cast("int"), at("b").try_cast("int"), F.upper(at("z"))
    signed, digits = F.regexp_like(zone, F.lit("^[+-]")), F.regexp_replace(zone, "[^0-9]", "")
    df = df.select(
        *kept,
        *[at(x).try_cast("int").alias(w + x) for x in ("y", "mi", "s", "h")],
        F.when(at("a") == "", month).when(at("order") == "mdy", first).when(at("order") == "dmy", second).alias(w + "mo"),
        F.when(at("a") == "", at("d").try_cast("int")).when(at("order") == "mdy", second).when(at("order") == "dmy", first).alias(w + "d"),
        F.lower(at("ap")).alias(w + "ap"), at("h").alias(w + "hours"), at("e").try_cast("bigint").alias(w + "e"), F.length(at("e")).alias(w + "n"),
        F.rpad(F.substring(at("f"), 1, 6), 6, "0").try_cast("int").alias(w + "f"),
        F.when(signed, F.substring(digits, 1, 2)).try_cast("int").alias(w + "oh"), F.when(signed, F.substring(F.concat(digits, F.lit("00")), 3, 2)).try_cast("int").alias(w + "om"),
        F.when(zone.startswith("-"), -1).otherwise(1).alias(w + "sign"), _lookup(ABBREVIATIONS, zone, "int").alias(w + "abbr"),
        F.when(zone == "", at("feed")).otherwise(F.regexp_replace(at("z"), r"[\[\]]", "")).alias(w + "zone"),
    )
    hour = F.when(at("ap") == "", F.when(at("hours") == "", 0).otherwise(at("h"))).when(at("h").between(1, 12), at("h") % 12 + F.when(at("ap") == "p", 12).otherwise(0))
    df = df.select(
        *kept, *[at(x) for x in ("y", "mo", "d", "e", "n")], hour.alias(w + "h"), *[F.coalesce(at(x), F.lit(0)).alias(w + x) for x in ("mi", "s", "f")],
        F.when((at("oh") <= 18) & (at("om") <= 59), (at("oh") * 60 + at("om")) * at("sign")).otherwise(at("abbr")).alias(w + "shift"),
        F.when(at("zone").isin(names), at("zone")).alias(w + "zone"),
    )
    valid = at("mo").between(1, 12) & (at("d") >= 1) & (at("d") <= _month_length(at("y"), at("mo"))) & at("h").between(0, 23) & at("mi").between(0, 59) & at("s").between(0, 59)
    seconds = ((days_from_civil(at("y"), at("mo"), at("d")) * 24 + at("h")) * 60 + at("mi")) * 60 + at("s")
    df = df.select(*kept, *[at(x) for x in ("e", "n", "shift", "zone")], F.when(valid, seconds * 1_000_000 + at("f")).alias(w + "local"))
    since = F.when(at("n") <= 10, at("e") * 1_000_000).when(at("n") <= 13, at("e") * 1_000).otherwise(at("e"))
    by_rules = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(at("local")), at("zone")))
    found = F.when(at("e").isNotNull(), since).when(at("shift").isNotNull(), at("local") - at("shift").cast("bigint") * 60_000_000).when(at("zone").isNotNull(), by_rules)
    return df.select(*kept, (F.explode(F.array_compact(F.array(found))) if drop_missing else found).alias(into))
