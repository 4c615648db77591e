"""Profiles, differences and drift of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_profile(df: DataFrame) -> DataFrame:
    """(column, n_null, pct_null) of every column, in one pass."""
    cells = df.agg(F.count(F.lit(1)).alias("__n"), *[F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"c{i}"), F.lit(0)).alias("n_null")) for i, c in enumerate(df.columns)]))
    flat = cells.select("__n", rows.alias("r")).select("r.column", "r.n_null", F.col("__n"))
    return flat.select("column", "n_null", F.coalesce(F.try_divide(F.col("n_null") * 100.0, F.col("__n")), F.lit(0.0)).alias("pct_null"))


def describe_schema(df: DataFrame) -> DataFrame:
    """(position, column, type)."""
    return df.sparkSession.createDataFrame([(i, c, t) for i, (c, t) in enumerate(df.dtypes)], "position int, column string, type string")


def top_counts(df: DataFrame, c: str | Column, k: int | None = None) -> DataFrame:
    """(value, n), most frequent first, ties by value; all of them without ``k``."""
    value = F.col(c) if isinstance(c, str) else c
    rows = df.select(value.alias("value")).filter(F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return rows.orderBy(F.col("n").desc(), "value").limit(k) if k else rows


def rounded_histogram(df: DataFrame, c: str, digits: int = 2) -> DataFrame:
    """(value, n) of a number rounded to some digits."""
    return df.filter(F.col(c).isNotNull()).groupBy(F.round(c, digits).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def bucket_histogram(df: DataFrame, c: str, width: float = 10.0) -> DataFrame:
    """(bucket, n): lower ends of buckets of one width."""
    return df.filter(F.col(c).isNotNull()).groupBy((F.floor(F.col(c) / width) * width).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def extent(df: DataFrame, c: str) -> DataFrame:
    """(n, lowest, highest, mean) of the values that are there."""
    return df.filter(F.col(c).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.min(c).alias("lowest"), F.max(c).alias("highest"), F.avg(c).alias("mean"))


def distinct_counts(df: DataFrame, columns: list[str], count_null: bool = False) -> DataFrame:
    """(column, n_distinct), exact; NULL counts as a value if asked for.

    Values are made distinct by column first, so no task holds a column's values as one set.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    rows = df.select(F.explode(cells).alias("c")).select("c.*").distinct()
    counted = F.count(F.lit(1)) if count_null else F.count("value")
    return rows.groupBy("column").agg(counted.alias("n_distinct"))


def repeated(df: DataFrame, c: str, k: int | None = None) -> DataFrame:
    """(value, n) of values that come more than once, most frequent first."""
    rows = df.groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return rows.orderBy(F.col("n").desc(), "value").limit(k) if k else rows


def means(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the mean of each column."""
    return df.agg(*[F.avg(c).alias(f"avg_{c}") for c in columns])


def value_shares(df: DataFrame, c: str | Column, listed: tuple[str, ...] | None = None) -> DataFrame:
    """(value, n, pct): counts and percentages; listed values that do not occur count 0."""
    value = F.col(c) if isinstance(c, str) else c
    counts = df.select(value.alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    if listed:
        counts = df.sparkSession.createDataFrame([(x,) for x in listed], "value string").join(counts, "value", "full").select("value", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over the few counted values
    return counts.select("value", "n", F.coalesce(F.try_divide(F.col("n") * 100.0, total), F.lit(0.0)).alias("pct"))


def class_stats(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """(label, column, n, mean, std, min, p25, p50, p75, max), exact and interpolated."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])
    rows = df.select(F.col(label).alias("label"), F.explode(cells).alias("c")).select("label", "c.*").filter(F.col("x").isNotNull())
    parts = F.percentile("x", [0.25, 0.5, 0.75])
    found = rows.groupBy("label", "column").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), parts.alias("p"), F.max("x").alias("max"))
    return found.select("label", "column", "n", "mean", "std", "min", *[F.get("p", F.lit(i)).alias(name) for i, name in enumerate(("p25", "p50", "p75"))], "max")


def quantile(df: DataFrame, c: str, q: float) -> DataFrame:
    """(q, value): exact quantile, interpolated between neighbours."""
    return df.agg(F.percentile(c, F.lit(q)).alias("value")).select(F.lit(q).alias("q"), "value")


def mean_drift(train: DataFrame, live: DataFrame, columns: list[str], threshold: float = 0.2) -> DataFrame:
    """(feature, mean_train, mean_live, z, drifted): shift of the mean in training deviations; constant features are left out."""
    a = train.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in columns])
    b = live.agg(*[F.avg(c).alias(f"live_{c}") for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}.m").alias("mean_train"), F.col(f"live_{c}").alias("mean_live"), F.col(f"{c}.s").alias("s")) for c in columns])
    rows = a.crossJoin(b).select(F.explode(cells).alias("c")).select("c.*").filter((F.col("s") > 0) & ~F.isnan("s"))  # one row by one row
    z = F.abs(F.col("mean_live") - F.col("mean_train")) / F.col("s")
    return rows.select("feature", "mean_train", "mean_live", z.alias("z"), (z > threshold).alias("drifted"))


def filled_counts(df: DataFrame, sides: dict[str, list[str]]) -> DataFrame:
    """(side, mean_filled): mean number of columns with content per side."""
    def filled(columns: list[str]) -> Column:
        return reduce(lambda a, b: a + b, [F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "", 1).otherwise(0) for c in columns])

    one = df.agg(*[F.avg(filled(columns)).alias(side) for side, columns in sides.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("mean_filled")) for s in sides])).alias("c")).select("c.*")


def correlations(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """(feature, correlation, mean_1, mean_0): Pearson correlation with a 0/1 label and the class means."""
    one = df.agg(*[F.struct(F.corr(c, label).alias("r"), F.avg(F.when(F.col(label) == 1, F.col(c))).alias("p"), F.avg(F.when(F.col(label) == 0, F.col(c))).alias("q")).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}.r").alias("correlation"), F.col(f"{c}.p").alias("mean_1"), F.col(f"{c}.q").alias("mean_0")) for c in columns])
    return one.select(F.explode(cells).alias("c")).select("c.*")


def keys_only_in(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``a`` that ``b`` lacks."""
    return a.select(key).filter(F.col(key).isNotNull()).distinct().join(b.select(key), key, "left_anti")


def shared_key(a: DataFrame, b: DataFrame) -> str | None:
    """The first column of both tables whose name tells of an id or a key."""
    return next((c for c in a.columns if c in b.columns and any(w in c.lower() for w in ("id", "key"))), None)


def schema_difference(a: DataFrame, b: DataFrame) -> dict[str, list[str]]:
    """Columns of both, and of one only."""
    return {"common": [c for c in a.columns if c in b.columns], "only_a": [c for c in a.columns if c not in b.columns], "only_b": [c for c in b.columns if c not in a.columns]}


def columns_with(df: DataFrame, literal: str) -> DataFrame:
    """(column, n): string columns that hold a literal."""
    strings = [c for c, t in df.dtypes if t == "string"]
    if not strings:
        return df.sparkSession.createDataFrame([], "column string, n long")
    one = df.agg(*[F.sum(F.when(F.col(f"`{c}`") == literal, 1).otherwise(0)).alias(f"c{i}") for i, c in enumerate(strings)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").cast("long").alias("n")) for i, c in enumerate(strings)])
    return one.select(F.explode(cells).alias("c")).select("c.*").filter(F.col("n") > 0)


def differing_cells(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(column, n): how many joined rows differ in each column."""
    joined = a.select(key, *[F.col(c).alias(f"a_{c}") for c in columns]).join(b.select(key, *[F.col(c).alias(f"b_{c}") for c in columns]), key)
    one = joined.agg(*[F.sum(F.when(F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), 0).otherwise(1)).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("n")) for c in columns])).alias("c")).select("c.*")


def class_weights(df: DataFrame, label: str, cap: float = 10.0) -> DataFrame:
    """(label, n, weight): balanced weights n / (k n_c), capped."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy()  # over the few classes
    weight = F.sum("n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("n"))
    return counts.select("label", "n", F.least(weight, F.lit(cap)).alias("weight"))


def positive_weight(df: DataFrame, label: str, positive: str = "alt", negative: str = "base", cap: float = 10.0) -> DataFrame:
    """(weight): negatives per positive, capped."""
    n = lambda v: F.sum(F.when(F.col(label) == v, 1).otherwise(0))
    return df.agg(F.least(F.coalesce(F.try_divide(n(negative).cast("double"), n(positive)), F.lit(1.0)), F.lit(cap)).alias("weight"))


def match_category(base_hit: Column, alt_hit: Column) -> Column:
    """Which sides a truth value matches."""
    return F.when(base_hit & alt_hit, "both").when(base_hit, "base_only").when(alt_hit, "alt_only").otherwise("neither")
