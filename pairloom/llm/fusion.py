"""One surviving record per group of duplicates, chosen field by field.

Bayesian fusion with copy detection. The sources named by a duplicate vote for its values. The accuracy of a source is
the mean posterior of the values it votes for; two sources depend on each other if they share false values more often
than independent ones would, and of dependent votes for one value only what is left counts. Both are fixed points,
sought until accuracies stand still.

One posterior decides. Its prior speaks for the value of the duplicate that is newer than all others and of the one that
is more trusted than all others, each moderately, so that votes can overrule either, and strongly where both are the
same duplicate (``Prior``). The value of the highest posterior survives, in the words of its most trusted, then newest
duplicate. An exact check tells if that duplicate is undisputed: newer and more trusted than every other candidate.

Only groups of two or more different ids are read on. All is sums and maxima per group and value, so a group that holds
a third of all rows is aggregated before it is shuffled. Sources are learnt from the distinct voting patterns of groups.
What reaches the driver are accuracies and pairs of sources; their number is checked.

Defined results: a field is filled if text remains apart from nulls, JSON marks and keys; JSON that cannot be read
fills nothing; plain text does. Groups without a filled field have no row for it. A missing instant or confidence (NULL
or NaN) is less than any other. NULL ids and group ids are left out, repeated rows count once. Equal posteriors fall to
the more trusted, then newer, then greater id.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from pairloom.functions.jsonx import as_objects, unwrap_json
from pairloom.functions.text import website
from pairloom.functions.timestamps import with_instants
from pairloom.llm.addresses import located
from pairloom.llm.consensus import winner
from pairloom.session import bounded_rows, broadcast_within, cut_lineage

FIELDS = ("phones", "websites", "addresses")

#: Golden column that tells on a field; there is none for websites.
GOLDEN = {"phones": "attr_phone_winner", "addresses": "attr_address_winner"}

#: Calling codes of one or two digits; all others have three.
CALLING_CODES = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"

#: Pairs of voters that one task counts in each round of learning; more are spread.
ONE_TASK = 100_000

#: Order of missing instants and confidences.
NO_INSTANT, NO_CONFIDENCE = -(2**62), -1e300


def remaining_text(text: Column) -> Column:
    """The text of an opened JSON or plain column without nulls, marks and keys; NULL if nothing is left."""
    marked = F.regexp_like(text, F.lit(r'^\s*(?:[\[{"]|null\s*$)'))
    # keys, nulls, marks and escaped white space in one sweep
    values = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"\s*:|\bnull\b(?=\s*[\],}]|\s*$)|[\[\]{}:,"]|\\[nrt]', " ")
    left = F.when(~marked, text).when(F.try_parse_json(text).isNotNull(), values)
    left = F.regexp_replace(left, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return F.nullif(left, F.lit(""))


def _phone(c: Column) -> Column:
    """The national digits of a number, whether or not its calling code and trunk zero are written."""
    plain = F.regexp_replace(F.regexp_replace(c, r"\(0\)", ""), r"[^\d+]", "")
    plain = F.regexp_replace(plain, rf"^(?:\+|00)(?:{CALLING_CODES})(?=\d{{4}})|^1(?=\d{{10}}$)", "")
    return F.regexp_replace(plain, r"^[0+]+|\+", "")


def _site(c: Column) -> Column:
    """Host and path of a URL, without marks of where a visitor comes from."""
    return website(F.regexp_replace(c, r"(?i)#.*$|[?&](?:ref|utm_\w+|gclid|fbclid)=[^&#]*", ""))


def value_key(field: str, text: Column) -> Column:
    """A number that is equal for values (opened JSON or plain text) that say the same, whatever their writing.

    All phones and all websites of a value count, in any order. Addresses are told apart as written; see ``place_keys``.
    """
    if field == "addresses":
        return F.xxhash64(F.lower(text))
    items = F.coalesce(F.from_json(text, "array<string>"), F.split(text, "[,;]"))
    normal = F.transform(items, _phone if field == "phones" else _site)
    normal = F.array_sort(F.array_distinct(F.filter(normal, lambda x: x != "")))
    # bound by a lambda, so that JSON is read once
    return F.get(F.transform(F.array(normal), lambda n: F.xxhash64(n, F.when(F.size(n) == 0, F.lower(text)))), F.lit(0))


def place_keys(df: DataFrame) -> DataFrame:
    """(base_id, id, place): a number that is equal for addresses of one location, whatever their writing.

    All addresses of a value count, in any order: town, number and street after the rewrites and misspellings mined
    from both sides of all rows, and of an address without location all its parts.
    """
    if "base_addresses" not in df.columns:
        df = df.withColumn("base_addresses", F.lit(None).cast("string"))
    rows = df.filter(F.col("id").isNotNull() & F.col("base_id").isNotNull())
    said = located(rows, ("id", "addresses"), ("base_id", "base_addresses")).said().select(F.col("b_id").alias("base_id"), F.col("a_id").alias("id"), "said")
    return said.groupBy("base_id", "id").agg(F.xxhash64(F.array_sort(F.collect_set("said"))).alias("place"))


def in_groups(df: DataFrame) -> DataFrame:
    """Rows of groups (base_id) that have two or more different ids."""
    rows = df.filter(F.col("id").isNotNull() & F.col("base_id").isNotNull())
    groups = rows.groupBy("base_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter(F.col("a") != F.col("z")).select("base_id")
    return rows.join(broadcast_within(groups, 2_000_000), "base_id", "left_semi")


def duplicates(df: DataFrame, feeds: DataFrame, golden: DataFrame) -> DataFrame:
    """One row per group and duplicate: base_id, id, instant, confidence, and per field a struct (key, voters) or NULL.

    Groups of one id are no duplicates. A duplicate is no candidate for a field if it does not fill it or golden gives
    the field to base or none.
    """
    df = rows = in_groups(df)
    confidence = F.coalesce(F.when(~F.isnan("confidence"), F.col("confidence")), F.lit(NO_CONFIDENCE))
    rows = rows.select("base_id", "id", confidence.alias("confidence"), "sources", *[unwrap_json(F.col(f)).alias(f) for f in FIELDS])
    keys = [F.when(remaining_text(F.col(f)).isNotNull(), value_key(f, F.col(f))).alias(f"k_{f}") for f in FIELDS]
    # keys are made before entries are exploded, once per row
    rows = rows.select("base_id", "id", "confidence", *keys, as_objects(F.col("sources"), "dataset:string,update_time:string,property:string").alias("entries"))
    rows = rows.select("base_id", "id", "confidence", *[f"k_{f}" for f in FIELDS], F.explode_outer("entries").alias("entry"))
    rows = rows.select("base_id", "id", "confidence", *[f"k_{f}" for f in FIELDS], F.lower(F.trim("entry.dataset")).alias("source"), F.col("entry.update_time").alias("written"), F.trim(F.coalesce("entry.property", F.lit(""))).alias("property"))
    rows = with_instants(rows, "written", "source", feeds, into="instant")
    speaks = {f: (F.col("property") == "") | F.col("property").endswith(f) for f in FIELDS}
    one = rows.groupBy("base_id", "id").agg(
        F.coalesce(F.max("instant"), F.lit(NO_INSTANT)).alias("instant"), F.max("confidence").alias("confidence"), *[F.max(f"k_{f}").alias(f"k_{f}") for f in FIELDS],
        *[F.array_sort(F.collect_set(F.when(speaks[f], F.col("source")))).alias(f"v_{f}") for f in FIELDS],
    )
    one = one.join(place_keys(df), ["base_id", "id"], "left").withColumn("k_addresses", F.when(F.col("k_addresses").isNotNull(), F.coalesce("place", "k_addresses"))).drop("place")
    told = golden.filter(F.col("id").isNotNull()).groupBy(F.col("id").alias("golden_id")).agg(*[F.coalesce(F.max(winner(F.col(c)).isin("base", "none")), F.lit(False)).alias(f"not_{f}") for f, c in GOLDEN.items()])
    one = one.join(told, one["id"] == told["golden_id"], "left")
    out = {f: F.when(F.col(f"k_{f}").isNotNull() & ~F.coalesce(F.col(f"not_{f}"), F.lit(False)) if f in GOLDEN else F.col(f"k_{f}").isNotNull(), F.struct(F.col(f"k_{f}").alias("key"), F.col(f"v_{f}").alias("voters"))) for f in FIELDS}
    return one.select("base_id", "id", "instant", "confidence", *[c.alias(f) for f, c in out.items()])


def claims(dups: DataFrame) -> DataFrame:
    """(base_id, field_name, key, voters, kept, newest, eldest, most, least): the values of each group and field.

    ``voters`` are all that name the value; ``kept`` is the duplicate that stands for it, the most trusted, then newest
    one. ``newest`` and ``eldest`` hold its greatest instant with the greatest and the smallest id that reach it,
    ``most`` and ``least`` the same of its confidence: a maximum is unique if both ids are the same.
    """
    fields = F.array(*[F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("field_name"), F.col(f"{f}.key").alias("key"), F.col(f"{f}.voters").alias("voters"))) for f in FIELDS])
    rows = dups.select("base_id", "id", "instant", "confidence", F.explode(F.array_compact(fields)).alias("f")).select("base_id", "id", "instant", "confidence", "f.*")
    return rows.groupBy("base_id", "field_name", "key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("voters")))).alias("voters"), F.max(F.struct("confidence", "instant", "id")).alias("kept"),
        F.max(F.struct("instant", "id")).alias("newest"), F.min(F.struct((-F.col("instant")).alias("instant"), "id")).alias("eldest"),
        F.max(F.struct("confidence", "id")).alias("most"), F.min(F.struct((-F.col("confidence")).alias("confidence"), "id")).alias("least"),
    )


@dataclass(frozen=True)
class Prior:
    """Log odds that a value is right before any vote.

    ``newest``: it is that of the one duplicate newer than all others; ``trusted``: of the one more trusted than all
    others; ``both``: besides, one duplicate is both. Votes of some dozens of accurate sources overrule 60.
    """

    newest: float = 2.0
    trusted: float = 2.0
    both: float = 60.0


@dataclass
class Sources:
    """Accuracy by source and probability of dependence by pair, the more accurate source first."""

    accuracy: dict[str, float]
    depends: dict[tuple[str, str], float]
    n_false: int = 10
    copied: float = 0.8

    def votes(self, voters: tuple[str, ...]) -> float:
        """The discounted vote count of a value."""
        total, before = 0.0, []
        for s in sorted(voters, key=lambda x: (-self.accuracy.get(x, 0.8), x)):
            a = self.accuracy.get(s, 0.8)
            independent = math.prod(1 - self.copied * self.depends.get((min(s, t), max(s, t)), 0.0) for t in before)
            total += independent * math.log(self.n_false * a / (1 - a))
            before.append(s)
        return total

    def posteriors(self, pattern: list[tuple[tuple[str, ...], int]]) -> list[float]:
        """The posterior of one value of each set of voters, given how many values have that set."""
        scores = [self.votes(v) for v, _ in pattern]
        top = max([0.0, *scores])
        n = sum(m for _, m in pattern)
        whole = sum(m * math.exp(s - top) for s, (_, m) in zip(scores, pattern, strict=True)) + max(self.n_false + 1 - n, 0) * math.exp(-top)
        return [math.exp(s - top) / whole for s in scores]


def learn_sources(claimed: DataFrame, tolerance: float = 1e-3, most_rounds: int = 50, prior: float = 0.1, max_sources: int = 1_000) -> Sources:
    """Accuracies and dependence of all sources by fixed-point rounds over the distinct voting patterns of groups.

    Rounds end when no accuracy moves by ``tolerance`` or more; a warning tells if ``most_rounds`` did not get there.
    """
    by_voters = claimed.groupBy("base_id", "field_name", "voters").agg(F.count(F.lit(1)).cast("int").alias("m"))
    patterns = by_voters.groupBy("base_id", "field_name").agg(F.sort_array(F.collect_list(F.struct("voters", "m"))).alias("pattern"))
    patterns = cut_lineage(patterns.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")))
    pairs = F.aggregate("pattern", F.lit(0), lambda s, p: s + F.size(p["voters"])).cast("double")
    if (patterns.agg(F.sum(pairs * pairs)).first()[0] or 0.0) <= ONE_TASK:
        patterns = patterns.coalesce(1)  # then a round has nothing to shuffle
    model = Sources({}, {})
    for _ in range(most_rounds):

        def run(batches: Iterator[pd.DataFrame], model: Sources = model) -> Iterator[pd.DataFrame]:
            sums: dict[tuple[str, str], list[float]] = {}
            for batch in batches:
                for pattern, n in zip(batch["pattern"], batch["n"], strict=True):
                    values = [(tuple(p["voters"]), int(p["m"])) for p in pattern]
                    chances = model.posteriors(values)
                    together: set[tuple[str, str]] = set()
                    for (voters, m), p in zip(values, chances, strict=True):
                        for i, a in enumerate(voters):
                            into = sums.setdefault((a, ""), [0.0, 0.0, 0.0])
                            into[0] += n * m * p
                            into[1] += n * m
                            for b in voters[i + 1 :]:
                                into = sums.setdefault((a, b), [0.0, 0.0, 0.0])
                                into[0] += n * m * p
                                into[1] += n * m * (1 - p)
                                together.add((a, b))
                    everyone = sorted({s for voters, _ in values for s in voters})
                    for i, a in enumerate(everyone):
                        for b in everyone[i + 1 :]:
                            if (a, b) not in together:
                                sums.setdefault((a, b), [0.0, 0.0, 0.0])[2] += n
            yield pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=["a", "b", "x", "y", "z"])

        total = patterns.mapInPandas(run, "a string, b string, x double, y double, z double").groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in "xyz"])
        rows = bounded_rows(total, max_sources * (max_sources + 1) // 2, "pairs of sources")
        accuracy = {r.a: min(max((r.x + 0.8) / (r.y + 1), 0.05), 0.95) for r in rows if r.b == ""}
        depends = {}
        for r in rows:
            if r.b:
                a = (accuracy[r.a] + accuracy[r.b]) / 2
                free = (a * a, (1 - a) ** 2 / model.n_false)
                copy = (a * model.copied + free[0] * (1 - model.copied), (1 - a) * model.copied + free[1] * (1 - model.copied))
                odds = r.x * math.log(copy[0] / free[0]) + r.y * math.log(copy[1] / free[1]) + r.z * math.log(1 - model.copied)
                depends[(r.a, r.b)] = 1 / (1 + (1 - prior) / prior * math.exp(-min(max(odds, -500), 500)))
        moved = max((abs(a - model.accuracy.get(s, 0.8)) for s, a in accuracy.items()), default=0.0)
        model = Sources(accuracy, depends, model.n_false, model.copied)
        if moved < tolerance:
            return model
    warnings.warn(f"accuracies of sources still move by {moved:.4f} after {most_rounds} rounds", stacklevel=2)
    return model


def with_votes(claimed: DataFrame, model: Sources, small_sets: int = 200_000) -> DataFrame:
    """``claimed`` with the discounted votes of each value; they are counted once per distinct set of voters."""
    sent = claimed.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = sent.value
        for batch in batches:
            yield batch.map(lambda v: known.votes(tuple(v))).astype(float)

    sets = claimed.select("voters").distinct()
    votes = sets.withColumn("votes", F.pandas_udf(count, DoubleType())("voters"))
    return claimed.join(broadcast_within(votes, small_sets), "voters")


def survivors(dups: DataFrame, prior: Prior = Prior()) -> DataFrame:
    """(base_id, field_name, id, posterior, n_values, is_undisputed): the surviving duplicate of each group and field.

    Only fields that some candidate fills. The posterior is worked out from sums per distinct vote count, of which a
    group has no more than there are sets of voters, with the greatest score taken off before any exponential.
    """
    claimed = cut_lineage(claims(dups))
    model = learn_sources(claimed)
    scored = with_votes(claimed, model)
    of_vote = scored.groupBy("base_id", "field_name", "votes").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("kept", "key")).alias("best"), F.max(F.struct("newest", "key", "kept")).alias("newest"), F.min("eldest").alias("eldest"),
        F.max(F.struct("most", "key", "kept")).alias("most"), F.min("least").alias("least"),
    )
    group = of_vote.groupBy("base_id", "field_name").agg(
        F.sum("n").alias("n_values"), F.collect_list(F.struct("votes", "n")).alias("counts"), F.max(F.struct("votes", "best")).alias("plain"),
        F.max(F.struct("newest", "votes")).alias("newest"), F.min("eldest").alias("eldest"), F.max(F.struct("most", "votes")).alias("most"), F.min("least").alias("least"),
    )
    newest, most = F.col("newest.newest"), F.col("most.most")
    one_newest, one_most = newest["newest"]["id"] == F.col("eldest.id"), most["most"]["id"] == F.col("least.id")
    sole = one_newest & one_most & (newest["newest"]["id"] == most["most"]["id"])
    together = newest["key"] == most["key"]
    plus = lambda when, x: F.when(when, F.lit(float(x))).otherwise(0.0)
    for_newest, for_most = plus(one_newest, prior.newest), plus(one_most, prior.trusted)
    bonus_newest = for_newest + F.when(together, for_most).otherwise(0.0) + plus(sole, prior.both)
    bonus_most = for_most + F.when(together, for_newest).otherwise(0.0) + plus(sole, prior.both)
    group = group.withColumns({"bonus_newest": bonus_newest, "bonus_most": bonus_most, "sole": F.when(sole, newest["newest"]["id"]), "together": together})
    options = F.array(
        F.struct(F.col("plain.votes").alias("score"), F.col("plain.best.kept").alias("kept")),
        F.struct((F.col("newest.votes") + F.col("bonus_newest")).alias("score"), newest["kept"].alias("kept")),
        F.struct((F.col("most.votes") + F.col("bonus_most")).alias("score"), most["kept"].alias("kept")),
    )
    group = group.withColumn("chosen", F.array_max(options)).withColumn("top", F.greatest(F.col("chosen.score"), F.lit(0.0)))
    top = F.col("top")
    grown = lambda votes, bonus: F.exp(votes + bonus - top) - F.exp(votes - top)
    whole = (
        F.aggregate("counts", F.lit(0.0), lambda s, x: s + x["n"] * F.exp(x["votes"] - top)) + F.greatest(F.lit(model.n_false + 1) - F.col("n_values"), F.lit(0)) * F.exp(-top)
        + grown(F.col("newest.votes"), F.col("bonus_newest")) + F.when(F.col("together"), 0.0).otherwise(grown(F.col("most.votes"), F.col("bonus_most")))
    )
    return group.select("base_id", "field_name", F.col("chosen.kept.id").alias("id"), (F.exp(F.col("chosen.score") - top) / whole).alias("posterior"), "n_values", F.coalesce(F.col("sole") == F.col("chosen.kept.id"), F.lit(False)).alias("is_undisputed"))
