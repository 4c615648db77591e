"""Postal addresses of one place written differently, made equal by rewrites mined from the addresses themselves.

1. Each address is cut into house number, street, town, region, postcode and country; unit, floor and landmark fall
   away. What towns, regions and postcodes belong together is learnt from the addresses that name several of them.
2. Pairs of addresses that agree in town and house number, and in all street words but one, propose a rewrite of that
   word, known by country and place in the street. A rewrite is kept if a word's partners are that other word far more
   often than chance has it (likelihood ratio) and in a fair share of all its pairs. Streets are re-normalised and
   mined again until no new rewrite appears.
3. A street of a town that never agrees with itself across a pair, lies one edit from a well supported street of that
   town and agrees with it elsewhere, or is too rare to be a street of its own, is a misspelling of it.

Addresses are parsed once. What they say but for the house number is a mention; all learning and looking up is done on
distinct mentions with their counts, and addresses get the result by the mention's key. Counts and statistics cover
all addresses. What is collected is the list of kept word rewrites (checked against ``max_rewrites``); gazetteers and
misspellings stay tables, broadcast only after a check of their rows and bytes.

Defined results: NULL, empty, unreadable addresses and addresses without street, number or town have no location.
Repeated rows count once.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pairloom.functions.text import STREET_WORDS
from pairloom.llm.skeleton import fold
from pairloom.session import bounded_rows, broadcast_within, cut_lineage, large_parts

#: Written forms of countries.
COUNTRIES = {
    "us": "us", "usa": "us", "united states": "us", "united states of america": "us", "gb": "gb", "uk": "gb", "united kingdom": "gb", "great britain": "gb",
    "de": "de", "germany": "de", "deutschland": "de", "fr": "fr", "france": "fr", "es": "es", "spain": "es", "espana": "es", "br": "br", "brazil": "br", "brasil": "br",
}

_UNIT_WORDS = r"unit|suite|ste|apt|apartment|apto|apartamento|appt|flat|floor|fl|level|piso|planta|puerta|sala|loja|bloco|andar|whg|wohnung|bat|batiment|esc|room|rm|top|bldg|building|box|lot"
_UNIT = re.compile(rf"^(?:(?:{_UNIT_WORDS})\b\.?\s*(?:no?\.?\s*)?#?\s*[\w-]*|#\s*\w+|(?:\d+\.?\s*)?(?:og|eg|ug|dg|stock)\b.*|\d+(?:er|re|e|eme|nd|rd|st|th)?\s*(?:etage|floor|fl)\b.*|\d+\s*[oa]\.?\s*(?:izq|izda|der|dcha|esq|dir|andar|piso)\b.*)$")
_TRAILING_UNIT = re.compile(rf"\s+(?:(?:{_UNIT_WORDS})\.?\s*#?\s*\d+\w*|#\s*\d+\w*|\d+\.?\s*og|\d+e\s+etage)$")
_POSTCODE = re.compile(r"\b(?:[a-z]{1,2}\d[a-z\d]?\s?\d[a-z]{2}|\d{5}-\d{3,4}|\d{8}|\d{5})\b")
_MARKED = re.compile(r"\b(?:no|nr|num|n)[.\so]*\s*(?=\d)")
_NUMBER = re.compile(r"(?<![\w-])(\d{1,5})(?:\s*-?\s*([a-z])(?![\w'./])|\s+([a-d])(?![\w'./]))?(?![\w])")
_HOUSE = re.compile(r"^(\d{1,5})\s*-?\s*([a-z])?$")
_GLUED = re.compile(r"^(.{3,}?)(strasse|str|platz|pl|weg|allee|gasse|g~)$")

#: Regions that normal addresses have written out as if they were street words.
WRITTEN_OUT = {full: short for short, full in STREET_WORDS if len(short) <= 3}

FIELDS = ("number", "street", "name", "region", "postcode", "country")


def _postcode(text: str | None) -> str:
    code = re.sub(r"[^0-9a-z]", "", fold(text or ""))
    return code[:5] if code.isdigit() and len(code) == 9 else code


def _street_and_number(segments: list[str]) -> tuple[str, str, list[str]]:
    """(number, street words, segments left over) of comma-separated parts."""
    number, street, rest = "", "", []
    for segment in segments:
        if _UNIT.match(segment):
            continue
        alone = _HOUSE.match(_MARKED.sub("", segment))
        if alone and not number:
            number = str(int(alone[1])) + (alone[2] or "")
        elif not street and re.search(r"[^\W\d_]", segment) and not (number and _POSTCODE.fullmatch(segment)):
            plain = _TRAILING_UNIT.sub("", _MARKED.sub("", segment))
            hits = list(_NUMBER.finditer(plain))
            if hits and not number:
                hit = hits[0] if hits[0].start() == 0 else hits[-1]
                letter = hit[2] or hit[3] or ""
                end = hit.end()
                if letter in "nsew" and letter and plain[hit.start(1) + len(hit[1]) :].startswith(" "):
                    letter, end = "", hit.end(1)  # a direction that stands apart
                number = str(int(hit[1])) + letter
                plain = plain[: hit.start()] + " " + plain[end:]
            plain = re.sub(r"(?<=[a-z]{4})g\.(?=\s|$)", "g~", plain)  # a type cut down to one letter and grown together
            street = " ".join(re.sub(r"[^\w~]+", " ", plain.replace("'", "")).split())
        else:
            rest.append(segment)
    return number, street, rest


@lru_cache(maxsize=50_000)
def parse_one(text: str, name: str, region: str, postcode: str, country: str) -> tuple[str, ...]:
    """The FIELDS of one address; ``text`` may hold all of it."""
    land = COUNTRIES.get(fold(country), fold(country))
    town, area, code = fold(name), fold(region), _postcode(postcode)
    segments = [s for s in (fold(x).strip(" .;") for x in re.split(r"[,;\n]", text)) if s]
    if segments and segments[-1] in COUNTRIES and len(segments) > 1:
        land = land or COUNTRIES[segments[-1]]
        segments.pop()
    if len(segments) > 2 and not code and _POSTCODE.fullmatch(segments[-1]) and (segments[-2] in WRITTEN_OUT or re.fullmatch(r"[a-z]{2,3}", segments[-2])):
        code = _postcode(segments.pop())  # town, region and postcode one after another, as normal addresses have them
    if len(segments) > 2 and segments[-1] in WRITTEN_OUT:
        segments[-1] = WRITTEN_OUT[segments[-1]]
    if len(segments) > 1 and (segments[-1] == area or re.fullmatch(r"[a-z]{2,3}", segments[-1])):
        area = area or segments[-1]
        segments.pop()
    kept = []
    for i, segment in enumerate(segments):
        if i and segment == town:
            continue
        hit = _POSTCODE.search(segment) if i else None
        if hit and (len(hit[0]) > 4):
            place = " ".join((segment[: hit.start()] + " " + segment[hit.end() :]).split())
            if not re.search(r"\d", place):
                code, town = code or _postcode(hit[0]), town or place
                continue
        kept.append(segment)
    number, street, rest = _street_and_number(kept)
    if not town and rest and not re.search(r"\d", rest[-1]):
        town = rest[-1]
    return number, street, town, area, code, land


def parse_all(text: str | None) -> list[tuple[str, ...]]:
    """The FIELDS of every address in one column value."""
    if text is None or not text.strip():
        return []
    value: object = text
    for _ in range(2):
        if isinstance(value, str):
            try:
                value = json.loads(value)
            except ValueError:
                if value.lstrip()[:1] in ("[", "{", '"'):
                    return []
                break
    out = []
    for item in value if isinstance(value, list) else [value]:
        if isinstance(item, dict):
            parts = [item.get(k) for k in ("freeform", "locality", "region", "postcode", "country")]
            out.append(parse_one(*(p if isinstance(p, str) else "" for p in parts)))
        elif isinstance(item, str) and item.strip():
            out.append(parse_one(item, "", "", "", ""))
    return out


def parsed_pairs(df: DataFrame, alt: tuple[str, str], base: tuple[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``df`` and address, with the parts of both sides: a_* from ``alt``, b_* from ``base``.

    ``alt`` and ``base`` name the columns of place id and addresses; the string columns ``keep`` are carried along.
    """
    columns = [*keep, "a_id", "b_id", *[f"{s}_{f}" for s in "ab" for f in FIELDS]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = ("",) * len(FIELDS)
        for batch in batches:
            rows = []
            for a_id, a_text, b_id, b_text, *others in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                left, right = parse_all(a_text), parse_all(b_text)
                for i in range(max(len(left), len(right))):
                    rows.append((*others, a_id, b_id, *(left[i] if i < len(left) else empty), *(right[i] if i < len(right) else empty)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.string()) for _ in columns], columns)

    slim = df.select(*[F.col(c) for c in (*alt, *base, *keep)]).filter(F.col(alt[1]).isNotNull() | F.col(base[1]).isNotNull())
    return slim.mapInArrow(run, ", ".join(f"{c} string" for c in columns))


def _given(c: str) -> Column:
    return F.col(c) != ""


def _head(street: str) -> Column:
    return F.substring_index(street, " ", 1)


def _tail(street: str) -> Column:
    return F.right(F.regexp_replace(street, "~", ""), F.lit(3))


#: What an address says but for its house number.
MENTION = ("street", "name", "region", "postcode", "country")

#: The two halves of a mention's 128-bit key.
KEY = ("k1", "k2")


def _keyed(pairs: DataFrame) -> DataFrame:
    """``pairs`` with the mention key of both sides, a_k1 .. b_k2; NULL where a side says nothing."""
    keys = {}
    for s in "ab":
        parts = [F.col(f"{s}_{f}") for f in MENTION]
        said = F.concat(*parts) != ""
        keys |= {f"{s}_{k}": F.when(said, F.xxhash64(F.lit(i), *parts)) for i, k in enumerate(KEY)}
    return pairs.withColumns(keys)


def mentions_of(keyed: DataFrame) -> DataFrame:
    """(k1, k2, street, name, region, postcode, country, n): distinct mentions with the number of their addresses."""
    both = F.array(*[F.struct(*[F.col(f"{s}_{c}").alias(c) for c in (*KEY, *MENTION)]) for s in "ab"])
    every = keyed.select(F.explode(both).alias("part")).select("part.*").filter(F.col("k1").isNotNull())
    return every.groupBy(*KEY, *MENTION).agg(F.count(F.lit(1)).alias("n"))


#: What mentions tell about each other: the parts that make the key, the part they tell and the least share it has
#: among all that the key tells.
LOOKUPS = (
    (("region",), "country", 0.8), (("name", "postcode"), "country", 0.8), (("postcode",), "country", 0.9), (("name",), "country", 0.9),
    (("postcode", "head"), "country", 0.95), (("postcode", "tail"), "country", 0.95), (("country", "postcode"), "name", 0.5),
)

#: A town is known that so many addresses name with their country.
KNOWN = 3


def gazetteers(told: DataFrame, gazetteer_rows: int) -> list[DataFrame]:
    """(__key, __value) of each of LOOKUPS, and at the end the key of every known town.

    All are counted and measured together: one by one they are plans of dozens of shuffles.
    """
    said = [(keys, F.col(value)) for keys, value, _ in LOOKUPS] + [(("country", "name"), F.lit(""))]
    needs = [(*keys, value) for keys, value, _ in LOOKUPS] + [("country", "name")]
    entries = [F.when(reduce(lambda x, y: x & y, map(_given, need)), F.struct(F.lit(i).alias("kind"), F.concat_ws("\u0001", *keys).alias("__key"), value.alias("__value"))) for i, ((keys, value), need) in enumerate(zip(said, needs, strict=True))]
    counts = told.select("n", F.explode(F.array_compact(F.array(*entries))).alias("entry")).groupBy("entry.kind", "entry.__key", "entry.__value").agg(F.sum("n").alias("n"))
    top = counts.groupBy("kind", "__key").agg(F.max_by("__value", F.struct("n", "__value")).alias("__value"), F.max("n").alias("top"), F.sum("n").alias("all"))
    shares = F.array(*[F.lit(share) for _, _, share in LOOKUPS])
    enough = F.when(F.col("kind") < len(LOOKUPS), F.col("top") >= F.get(shares, F.col("kind")) * F.col("all")).otherwise(F.col("all") >= KNOWN)
    kept = cut_lineage(top.filter(enough).select("kind", "__key", "__value"))
    large = large_parts(kept, "kind", gazetteer_rows)
    parts = [kept.filter(F.col("kind") == i).select("__key", "__value") for i in range(len(said))]
    return [part if i in large else F.broadcast(part) for i, part in enumerate(parts)]


def with_towns(mentions: DataFrame, gazetteer_rows: int = 200_000) -> DataFrame:
    """Fill the country of every mention from what other mentions say, and add its town.

    A mention that lacks a part gets a key of its own for it, so that no join has a hot empty key.
    """
    rows = mentions.withColumns({"head": _head("street"), "tail": _tail("street")})
    *told, known = gazetteers(rows.filter(_given("country")), gazetteer_rows)

    def joined(df: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        there = reduce(lambda x, y: x & y, [_given(k) for k in keys])
        key = F.when(there, F.concat_ws("\u0001", *keys)).otherwise(F.concat(F.lit("\u0000"), F.col("k1").cast("string")))
        return df.withColumn("__key", key).join(right, "__key", "left").drop("__key")

    for (keys, value, _), right in zip(LOOKUPS, told, strict=True):
        rows = joined(rows, right, keys)
        if value == "country":
            rows = rows.withColumn("country", F.when(_given("country"), F.col("country")).otherwise(F.coalesce("__value", F.lit("")))).drop("__value")
    rows = joined(rows, known.select("__key", F.lit(True).alias("__known")), ("country", "name"))
    town = F.when(F.col("__known"), F.col("name")).otherwise(F.coalesce(F.when(_given("postcode"), F.col("__value")), F.nullif("name", F.lit(""))))
    return rows.withColumn("town", F.coalesce(F.concat(town, F.lit("|"), F.col("country")), F.lit(""))).drop("__value", "__known", "head", "tail")


def split_street(country: str, street: str) -> list[str]:
    """The words of a street; a street type grown together with its name is cut off where that is the custom."""
    words = street.split()
    if country == "de" and words and (hit := _GLUED.match(words[-1])):
        words[-1:] = [hit[1], hit[2].rstrip("~")]
    return [w.rstrip("~") for w in words]


def places_of(words: list[str]) -> list[str]:
    """Where each word stands: first, last or between."""
    n = len(words)
    return ["f" if i == 0 and n > 1 else "l" if i == n - 1 else "m" for i in range(n)]


def rewritten(words: list[str], country: str, rewrites: dict[tuple[str, str, str], str]) -> list[str]:
    """Words after all rewrites; each word is followed to the end of its chain."""
    out = []
    for word, spot in zip(words, places_of(words), strict=True):
        seen = {word}
        while (nxt := rewrites.get((country, spot, word))) and nxt not in seen:
            seen.add(nxt)
            word = nxt
        out.append(word)
    return out


def normalise_streets(country: Column, street: Column, rewrites: dict[tuple[str, str, str], str]) -> Column:
    """Street with all kept rewrites applied, as one string."""

    def run(countries: pd.Series, streets: pd.Series) -> pd.Series:
        cache: dict[tuple[str, str], str] = {}
        out = []
        for pair in zip(countries, streets, strict=True):
            if pair not in cache:
                cache[pair] = " ".join(rewritten(split_street(*pair), pair[0], rewrites))
            out.append(cache[pair])
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, StringType())(country, street)


def _likelihood_ratio(k: int, n: int, p0: float) -> float:
    """G² of k hits among n against the rate p0; 0 where the rate is not exceeded."""
    p0 = min(max(p0, 1e-9), 1 - 1e-9)
    if n == 0 or k / n <= p0:
        return 0.0
    term = lambda x, q: x * math.log(q) if x else 0.0
    p = k / n
    return 2 * (term(k, p) + term(n - k, 1 - p) - term(k, p0) - term(n - k, 1 - p0))


def mine_rewrites(evidence: DataFrame, support: int = 3, significance: float = 15.0, share: float = 0.12, max_rewrites: int = 100_000) -> dict[tuple[str, str, str], str]:
    """Word rewrites from ``evidence`` (country, a_street, b_street, n): pairs of streets that agree elsewhere.

    A word a becomes b if they stand against each other in at least ``support`` pairs, in at least ``share`` of all
    pairs of a, and the likelihood ratio against chance is at least ``significance``. Mining goes on until no new
    rewrite appears; it ends, as each word of a place in the street is rewritten once.
    """
    rewrites: dict[tuple[str, str, str], str] = {}
    schema = "country string, spot string, a string, b string, n long"
    while True:
        current = dict(rewrites)

        def run(batches: Iterator[pd.DataFrame], current: dict[tuple[str, str, str], str] = current) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows: dict[tuple[str, str, str, str], int] = {}
                for country, left, right, n in zip(batch["country"], batch["a_street"], batch["b_street"], batch["n"], strict=True):
                    x, y = (rewritten(split_street(country, s), country, current) for s in (left, right))
                    if len(x) != len(y) or not x:
                        continue
                    apart = [i for i in range(len(x)) if x[i] != y[i]]
                    if len(apart) > 1:
                        continue
                    for i, spot in enumerate(places_of(x)):
                        for key in ((country, spot, x[i], y[i]), (country, spot, y[i], x[i])):
                            rows[key] = rows.get(key, 0) + int(n)
                yield pd.DataFrame([(*k, v) for k, v in rows.items()], columns=["country", "spot", "a", "b", "n"])

        counted = evidence.mapInPandas(run, schema).groupBy("country", "spot", "a", "b").agg(F.sum("n").alias("n"))
        counted = cut_lineage(counted)
        # pairs are counted both ways round, so what stands against b is what b stands against
        of_word = counted.groupBy("country", "spot", "a").agg(F.sum("n").alias("n_a"), F.sum(F.when(F.col("a") != F.col("b"), F.col("n"))).alias("n_b"))
        of_other = of_word.select("country", "spot", F.col("a").alias("b"), F.col("n_a").alias("all_b"), "n_b")
        total = of_word.groupBy("country", "spot").agg(F.sum("n_a").alias("n_all"))
        apart = counted.filter((F.col("a") != F.col("b")) & (F.col("n") >= support))
        scored = apart.join(of_word.drop("n_b"), ["country", "spot", "a"]).join(of_other, ["country", "spot", "b"]).join(total, ["country", "spot"])
        scored = scored.filter(F.col("n") >= share * F.col("n_a"))
        found = bounded_rows(scored.select("country", "spot", "a", "b", "n", "n_a", "n_b", "n_all", "all_b"), max_rewrites, "mined rewrites")
        fresh: dict[tuple[str, str, str], tuple[int, str]] = {}
        for r in found:
            chance = r.n_b / max(r.n_all, 1)
            if _likelihood_ratio(r.n, r.n_a, chance) < significance or (r.all_b, len(r.b), r.b) <= (r.n_a, len(r.a), r.a):
                continue
            key = (r.country, r.spot, r.a)
            if key not in rewrites and (r.n, r.b) > fresh.get(key, (0, "")):
                fresh[key] = (r.n, r.b)
        if not fresh:
            return rewrites
        rewrites |= {k: b for k, (_, b) in fresh.items()}


def misspelt_streets(together: DataFrame, written: DataFrame, rare: int = 2, per_hundred: float = 1.0, dwarfed: int = 8) -> DataFrame:
    """(town, street, right): streets of a town that are misspellings of another street there.

    ``together`` (town, a_street, b_street, k) counts the pairs that agree in town and number by their streets after
    rewrites; ``written`` (town, street, written, n) the addresses by street, after rewrites and, without spaces, before
    them. The words of a
    misspelling lie one insertion, loss, change or swap of neighbours from some way the right street is written. It
    never stands on both sides of a pair and either stands against the right street in a pair with the same number or
    occurs at most ``rare`` times plus ``per_hundred`` percent of its times; or it stands against a street that is
    ``dwarfed`` times as common. The right street has to stand on both sides of some pair, or neither does and it is
    the more common one of two that stand against each other. The best supported right street is taken.
    """
    sure = together.filter(F.col("a_street") == F.col("b_street")).select("town", F.col("a_street").alias("street"), F.col("k").alias("itself"))
    against = together.filter(F.col("a_street") != F.col("b_street"))
    against = against.select("town", "a_street", "b_street", "k").unionByName(against.select("town", F.col("b_street").alias("a_street"), F.col("a_street").alias("b_street"), "k"))
    against = against.groupBy("town", F.col("a_street").alias("street"), F.col("b_street").alias("right")).agg(F.sum("k").alias("k"))
    forms = written.groupBy("town", "street").agg(F.sum("n").alias("n")).join(sure, ["town", "street"], "left")
    # what can be wrong: streets never sure of themselves, and those that some street of the town dwarfs
    most = forms.groupBy("town").agg(F.max("n").alias("most"))
    wrong = F.col("itself").isNull() | (F.col("n") * dwarfed <= F.col("most"))
    written = written.drop("n").join(forms, ["town", "street"]).join(most, "town").withColumns({"w": F.xxhash64("town", "street", "written"), "wrong": wrong})
    written = cut_lineage(written.drop("most"))  # read four times
    doubtful, written = written.filter("wrong").drop("wrong"), written.drop("wrong")

    def signs(rows: DataFrame, name: str) -> DataFrame:
        """(name, sign): the key of each row under hashes of its writing and of the writing less one letter."""
        w = F.col("written")
        less = F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
        return rows.select(F.col("w").alias(name), F.explode(F.array_distinct(F.transform(F.array_union(F.array(w), less), lambda x: F.xxhash64("town", x)))).alias("sign"))

    # only keys are shuffled; rows that met by a sign are fetched and compared
    met = signs(doubtful, "w").join(signs(written, "w_right"), "sign").filter(F.col("w") != F.col("w_right")).select("w", "w_right").distinct()
    right = written.select(F.col("w").alias("w_right"), F.col("town").alias("town_right"), F.col("street").alias("right"), F.col("written").alias("as"), F.col("n").alias("n_right"), F.col("itself").alias("itself_right"))
    near = met.join(doubtful, "w").join(right, "w_right").filter((F.col("town") == F.col("town_right")) & (F.col("street") != F.col("right"))).drop("w", "w_right", "town_right")
    near = near.filter(F.col("itself").isNull() | (F.col("n") * dwarfed <= F.col("n_right")))
    distance = F.levenshtein("written", "as")
    letters = lambda c: F.array_sort(F.split(c, ""))
    near = near.filter((distance <= 1) | ((distance == 2) & (F.length("written") == F.length("as")) & (letters("written") == letters("as"))))
    near = near.join(against, ["town", "street", "right"], "left")
    met, firm = F.col("k").isNotNull(), F.col("itself_right").isNotNull()
    odd = F.col("itself").isNull() & firm & (met | (F.col("n") <= rare + F.col("n_right") * per_hundred / 100))
    unsure = F.col("itself").isNull() & ~firm & met & (F.struct("n_right", "right") > F.struct(F.col("n").alias("n_right"), F.col("street").alias("right")))
    near = near.filter(odd | unsure | (met & (F.col("n") * dwarfed <= F.col("n_right"))))
    return near.groupBy("town", "street").agg(F.max_by("right", F.struct(F.coalesce("k", F.lit(0)), F.coalesce("itself_right", F.lit(0)), "n_right", "right")).alias("right"))


@dataclass
class Located:
    """Parsed addresses and where their mentions lie.

    ``pairs`` has keep, a_id, b_id and by side the number and mention key of every row and address; ``mentions`` by key
    what was said, the town and the street after rewrites and corrections (without spaces; empty where there is none).
    """

    pairs: DataFrame
    mentions: DataFrame

    def _of(self, s: str) -> DataFrame:
        m = self.mentions.filter(_given("town") & _given("street"))
        return m.select(F.col("k1").alias(f"{s}_k1"), F.col("k2").alias(f"{s}_k2"), F.col("town").alias("__town"), F.col("right").alias("__street"))

    def _location(self, df: DataFrame, s: str) -> DataFrame:
        whole = F.when(_given(f"{s}_number"), F.col("__town"))
        joined = df.join(self._of(s), [f"{s}_{k}" for k in KEY], "left")
        location = F.when(whole.isNotNull(), F.concat_ws("/", whole, f"{s}_number", "__street"))
        return joined.withColumn(f"{s}_location", location).drop("__town", "__street")

    def rows(self, *keep: str) -> DataFrame:
        """(keep, a_id, b_id, a_location, b_location) of every row and address; without one, location is NULL."""
        return self._location(self._location(self.pairs, "a"), "b").select(*keep, "a_id", "b_id", "a_location", "b_location")

    def places(self) -> DataFrame:
        """(place, location): the locations of every place of either side; each address is looked up once."""
        sides = [self.pairs.select(F.col(f"{s}_id").alias("place"), F.col(f"{s}_number").alias("s_number"), *[F.col(f"{s}_{k}").alias(f"s_{k}") for k in KEY]) for s in "ab"]
        said = sides[0].unionByName(sides[1]).filter(F.col("place").isNotNull() & F.col("s_k1").isNotNull() & _given("s_number")).distinct()
        return self._location(said, "s").filter(F.col("s_location").isNotNull()).select("place", F.col("s_location").alias("location")).distinct()

    def said(self) -> DataFrame:
        """(a_id, b_id, said): the location of every alt address, or all that it says where it has none."""
        asked = self.pairs.filter(F.col("a_k1").isNotNull() | _given("a_number")).select("a_id", "b_id", "a_number", "a_k1", "a_k2").distinct()
        m = self.mentions.select(F.col("k1").alias("a_k1"), F.col("k2").alias("a_k2"), "town", "street", "right", "region", "postcode", "country")
        text = [F.coalesce(F.col(c), F.lit("")) for c in ("town", "a_number", "street", "region", "postcode", "country")]
        whole = _given("town") & _given("street") & _given("a_number")
        told = F.when(whole, F.concat_ws("/", "town", "a_number", "right")).otherwise(F.concat_ws("/", F.lit("-"), *text))
        return asked.join(m, ["a_k1", "a_k2"], "left").select("a_id", "b_id", told.alias("said"))


def located(df: DataFrame, alt: tuple[str, str], base: tuple[str, str], keep: tuple[str, ...] = (), max_rewrites: int = 100_000, gazetteer_rows: int = 200_000) -> Located:
    """Parse, learn and look up the addresses of ``alt`` and ``base`` (place id and addresses columns) of ``df``."""
    keyed = _keyed(cut_lineage(parsed_pairs(df, alt, base, keep)))
    mentions = cut_lineage(with_towns(cut_lineage(mentions_of(keyed)), gazetteer_rows))
    pairs = keyed.select(*keep, "a_id", "b_id", *[f"{s}_{c}" for s in "ab" for c in ("number", *KEY)])
    same = pairs.filter((F.col("a_number") == F.col("b_number")) & _given("a_number")).groupBy(*[f"{s}_{k}" for s in "ab" for k in KEY]).agg(F.count(F.lit(1)).alias("k"))
    placed = mentions.filter(_given("town") & _given("street"))
    for s in "ab":
        side = placed.select(*[F.col(k).alias(f"{s}_{k}") for k in KEY], F.col("town").alias(f"{s}_town"), F.col("country").alias(f"{s}_country"), F.col("street").alias(f"{s}_street"))
        same = same.join(side, [f"{s}_{k}" for k in KEY])
    same = same.filter(F.col("a_town") == F.col("b_town")).groupBy(F.col("a_town").alias("town"), F.col("a_country").alias("country"), "a_street", "b_street").agg(F.sum("k").alias("k"))
    same = cut_lineage(same)
    rewrites = mine_rewrites(cut_lineage(same.groupBy("country", "a_street", "b_street").agg(F.sum("k").alias("n"))), max_rewrites=max_rewrites)
    country, street = F.col("country"), F.col("street")
    normal = mentions.withColumns({"words": normalise_streets(country, street, {}), "normal": normalise_streets(country, street, rewrites)})
    together = same.select("town", *[normalise_streets(country, F.col(f"{s}_street"), rewrites).alias(f"{s}_street") for s in "ab"], "k")
    together = cut_lineage(together.groupBy("town", "a_street", "b_street").agg(F.sum("k").alias("k")))
    written = normal.filter(_given("town") & _given("normal")).groupBy("town", F.col("normal").alias("street"), F.regexp_replace("words", " ", "").alias("written")).agg(F.sum("n").alias("n"))
    wrong = cut_lineage(misspelt_streets(together, cut_lineage(written)))
    wrong = broadcast_within(wrong.select("town", F.col("street").alias("normal"), F.col("right").alias("__right")), gazetteer_rows)
    done = normal.join(wrong, ["town", "normal"], "left").withColumn("right", F.regexp_replace(F.coalesce("__right", "normal"), " ", ""))
    return Located(pairs, done.select(*KEY, *MENTION, "town", "right"))


def located_pairs(df: DataFrame, alt: tuple[str, str], base: tuple[str, str], keep: tuple[str, ...] = (), max_rewrites: int = 100_000) -> DataFrame:
    """(keep, a_id, b_id, a_location, b_location) of every row and address of ``df``; without one, location is NULL."""
    return located(df, alt, base, keep, max_rewrites).rows(*keep)


def places_of_rows(located_rows: DataFrame) -> DataFrame:
    """(place, location) of both sides of located rows."""
    sides = [located_rows.select(F.col(f"{s}_id").alias("place"), F.col(f"{s}_location").alias("location")) for s in "ab"]
    return sides[0].unionByName(sides[1]).filter(F.col("place").isNotNull() & F.col("location").isNotNull()).distinct()


def same_location(places: DataFrame) -> DataFrame:
    """(id_a, id_b): pairs of different places (place, location) at one location, the smaller id first."""
    left, right = places.select(F.col("place").alias("id_a"), "location"), places.select(F.col("place").alias("id_b"), "location")
    return left.join(right, "location").filter(F.col("id_a") < F.col("id_b")).select("id_a", "id_b").distinct()
