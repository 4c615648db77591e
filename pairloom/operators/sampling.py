"""Samples, splits, negatives and made-up labels, all by seeded hashes: the same rows on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.labels import label_3class, label_4class
from pairloom.functions.text import locality_and_postcode, primary
from pairloom.schemas import ATTRIBUTES
from pairloom.session import cut_lineage


def seeded(seed: int, *keys: str | Column) -> Column:
    """60 bits of an md5 that order rows at random but always alike, here and in any other engine."""
    text = F.concat_ws("\u0001", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """All rows in seeded order."""
    return df.orderBy(seeded(seed, key), key)


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows at random; a top-n of the hash, so no full sort."""
    return df.orderBy(seeded(seed, key), key).limit(n)


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows by explicit keys."""
    return df.orderBy(*order).limit(n)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the smallest by the order columns, by aggregation rather than a window."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("__b"))
    return best.select(*keys, *[F.col(f"__b.{c}").alias(c) for c in rest])


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42, slices: int = 64) -> DataFrame:
    """``df`` with a fold 0..k-1, classes spread evenly.

    Ranks are taken within slices of a class, each slice dealt out round by round, so no class is one task.
    """
    part = F.pmod(seeded(seed, key), F.lit(slices))
    window = Window.partitionBy(label, "__slice").orderBy(seeded(seed + 1, key), key)
    return df.withColumn("__slice", part).withColumn("fold", ((F.row_number().over(window) - 1 + F.col("__slice")) % k).cast("int")).drop("__slice")


def stratified_split(df: DataFrame, key: str, label: str, share: float = 0.2, seed: int = 42, slices: int = 64) -> DataFrame:
    """``df`` with is_test: of every class the same share of rows, rounded to the nearest row.

    A row's rank in its class is its rank within a slice of the class plus the counts of the slices before, so no class
    is one task.
    """
    rows = df.withColumn("__slice", F.pmod(seeded(seed, key), F.lit(slices)))
    counts = rows.groupBy(F.col(label).alias("__label"), "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__label").orderBy("__slice")) - F.col("__n")  # one row per class and slice
    counts = counts.select("__label", F.col("__slice").alias("__s"), before.alias("__before"), F.sum("__n").over(Window.partitionBy("__label")).alias("__all"))
    rank = F.row_number().over(Window.partitionBy(label, "__slice").orderBy(seeded(seed + 1, key), key)) - 1
    ranked = rows.withColumn("__rank", rank).join(counts, F.col(label).eqNullSafe(F.col("__label")) & (F.col("__slice") == F.col("__s")), "left")
    return ranked.withColumn("is_test", F.col("__rank") + F.col("__before") < F.round(F.col("__all") * share)).drop("__slice", "__label", "__s", "__before", "__all", "__rank")


def hash_split(df: DataFrame, key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """``df`` with is_test: a share of rows by hash, alike in all classes on average; needs no shuffle."""
    return df.withColumn("is_test", F.pmod(seeded(seed, key), F.lit(10_000)) < int(share * 10_000))


def _side(df: DataFrame, base: bool) -> DataFrame:
    p = "base_" if base else ""
    place = locality_and_postcode(F.col(f"{p}addresses"))
    rows = df.select(F.col(f"{p}id").alias("id"), primary(F.col(f"{p}names")).alias("name"), place.alias("place")).filter(F.col("id").isNotNull())
    return rows.distinct()


def random_negatives(df: DataFrame, n: int = 5_000, seed: int = 42) -> DataFrame:
    """(id, base_id): ``n`` pairs of places of different towns or postcodes, or all there are if they are fewer.

    A bounded sample of each side is numbered by hash. Number i of one side meets number i + turn of the other, round
    and round, for as many turns as it takes, so there is no cross join and no pair comes twice; pairs that happen to
    agree are dropped.
    """
    def numbered(base: bool, name: str) -> DataFrame:
        some = _side(df, base).orderBy(seeded(seed + base, "id"), "id").limit(n)
        order = Window.partitionBy("__g").orderBy(seeded(seed + base, "id"), "id")  # at most n rows
        return cut_lineage(some.withColumn("__g", F.lit(0)).withColumn("row", F.row_number().over(order) - 1).select(F.col("id").alias(name), F.col("place").alias(f"place_{name}"), "row"))

    left, right = numbered(False, "id"), numbered(True, "base_id").withColumnRenamed("row", "want")
    n_left, n_right = left.count(), right.count()
    turns = min(n_right, -(-5 * n // (4 * max(n_left, 1))) + 1) if n_left else 0
    while True:
        turn = left.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1)))) if turns else left.withColumn("turn", F.lit(0)).limit(0)
        pairs = turn.withColumn("want", ((F.col("row") + F.col("turn")) % max(n_right, 1)).cast("int")).join(right, "want")
        pairs = pairs.filter((F.col("id") != F.col("base_id")) & ((F.col("place_id.locality") != F.col("place_base_id.locality")) | (F.col("place_id.postcode") != F.col("place_base_id.postcode"))))
        found = cut_lineage(pairs.select("id", "base_id", "turn", seeded(seed, "id", "base_id").alias("h")).distinct())
        if turns >= n_right or found.select("id", "base_id").distinct().count() >= n:
            return found.groupBy("id", "base_id").agg(F.min("h").alias("h")).orderBy("h", "id", "base_id").limit(n).select("id", "base_id")
        turns = min(n_right, turns * 2)


def hard_negatives(df: DataFrame, names: int = 1_000, seed: int = 42, shortest: int = 4) -> DataFrame:
    """(name, id, base_id): places of one name in different towns, one pair per name.

    Per name and town the smallest id is kept before the join, so a name that many rows share stays small.
    """
    def towns(base: bool, name: str) -> DataFrame:
        rows = _side(df, base).filter(F.length("name") >= shortest)
        return rows.groupBy("name", F.col("place.locality").alias(f"town_{name}")).agg(F.min("id").alias(name))

    pairs = towns(False, "id").join(towns(True, "base_id"), "name").filter((F.col("town_id") != F.col("town_base_id")) & (F.col("id") != F.col("base_id")))
    one = pairs.groupBy("name").agg(F.min(F.struct("id", "base_id")).alias("p"))
    return one.select("name", "p.id", "p.base_id", seeded(seed, "name").alias("h")).orderBy("h", "name").limit(names).drop("h")


def synthetic_labels(golden: DataFrame, seed: int = 42, n_none: int | None = 70, none_share: float | None = None) -> DataFrame:
    """Golden rows with labels made up for rare classes, followed by the original both rows.

    Of the rows labelled both one half gets base's values on the alt side and three random winners base, the other
    half alt's values on the base side and winners alt; then ``n_none`` rows (or a share of all) get no winner at all.
    Labels are made again from the winners. Ids of appended rows come twice and stay so.
    """
    pairs = [("names", "base_names"), ("phones", "base_phones"), ("websites", "base_websites"), ("addresses", "base_addresses"), ("categories", "base_categories")]
    both = F.col("_label") == "both"
    half = F.pmod(seeded(seed, "id"), F.lit(2)) == 0
    rows = golden.withColumn("_label", label_3class()).withColumn("_to", F.when(both & half, "base").when(both, "alt"))
    cells: dict[str, Column] = {}
    for alt, base in pairs:
        if alt in golden.columns and base in golden.columns:
            cells |= {alt: F.when(F.col("_to") == "base", F.col(base)).otherwise(F.col(alt)), base: F.when(F.col("_to") == "alt", F.col(alt)).otherwise(F.col(base))}
    chosen = F.slice(F.array_sort(F.array(*[F.struct(seeded(seed + i, "id").alias("h"), F.lit(a).alias("a")) for i, a in enumerate(ATTRIBUTES)])), 1, 3)
    for a in ATTRIBUTES:
        w = f"attr_{a}_winner"
        cells[w] = F.when((F.col("_to") == "base") & F.array_contains(F.transform(chosen, lambda s: s["a"]), a), "base").when(F.col("_to") == "alt", "alt").otherwise(F.col(w))
    rows = rows.withColumns(cells)
    if none_share is not None:
        nothing = F.pmod(seeded(seed + 99, "id"), F.lit(10_000)) < int(none_share * 10_000)
        rows = rows.withColumn("_none", nothing)
    else:
        some = rows.select("id").distinct().orderBy(seeded(seed + 99, "id"), "id").limit(n_none or 0).withColumn("_none", F.lit(True))
        rows = rows.join(some, "id", "left")
    rows = rows.withColumns({f"attr_{a}_winner": F.when(F.col("_none"), "none").otherwise(F.col(f"attr_{a}_winner")) for a in ATTRIBUTES})
    made = rows.withColumns({"4class_testlabels": label_4class(), "3class_testlabels": label_3class()}).drop("_label", "_to", "_none")
    original = golden.withColumn("_label", label_3class()).filter(both).drop("_label").withColumns({"4class_testlabels": label_4class(), "3class_testlabels": label_3class()})
    return made.unionByName(original)


def hard_cases(df: DataFrame, c: str = "addr_similarity_ratio", low: float = 30.0, high: float = 80.0) -> DataFrame:
    """Rows of middling similarity."""
    return df.filter(F.col(c).between(low, high))
