"""Measures of classifications: one aggregation per table of predictions, whatever their number."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.labels import plain
from pairloom.session import cut_lineage


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0))


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def confusion(df: DataFrame, truth: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """(by, truth, pred, n): the counts of all pairs of labels that occur."""
    return df.groupBy(*(by or []), F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, truth: str, pred: str, labels: tuple[str, ...]) -> DataFrame:
    """One row per truth label with a column per predicted one; cells that do not occur are 0, other labels left out."""
    grid = df.sparkSession.createDataFrame([(x,) for x in labels], "truth string")
    counts = confusion(df, truth, pred).groupBy("truth").pivot("pred", list(labels)).agg(F.sum("n"))
    return grid.join(counts, "truth", "left").select("truth", *[F.coalesce(F.col(f"`{x}`"), F.lit(0)).cast("long").alias(f"pred_{x}") for x in labels])


def class_metrics(df: DataFrame, truth: str, pred: str, labels: tuple[str, ...], by: list[str] | None = None) -> DataFrame:
    """(by, n, accuracy, macro_f1, f1 of each label): macro over the given labels, absent ones counting 0."""
    t, p = F.col(truth), F.col(pred)
    sums = [F.count(F.lit(1)).alias("n"), F.sum(F.when(t == p, 1).otherwise(0)).alias("hits")]
    for x in labels:
        sums += [F.sum(F.when((t == x) & (p == x), 1).otherwise(0)).alias(f"tp_{x}"), F.sum(F.when((t == x) | (p == x), 1).otherwise(0)).alias(f"any_{x}")]
    counted = df.groupBy(*(by or [])).agg(*sums)
    f1 = {x: _f1(F.col(f"tp_{x}"), F.col(f"any_{x}") - F.col(f"tp_{x}"), F.lit(0)) for x in labels}
    macro = reduce(lambda a, b: a + b, f1.values()) / len(labels)
    return counted.select(*(by or []), F.col("n").cast("long").alias("n"), _share(F.col("hits"), F.col("n")).alias("accuracy"), macro.alias("macro_f1"), *[c.alias(f"f1_{x}") for x, c in f1.items()])


def binary_metrics(df: DataFrame, truth: str, pred: str, positive: str = "alt", negative: str = "base", by: list[str] | None = None) -> DataFrame:
    """(by, n, accuracy, precision, recall, f1, tp, fp, fn, tn); rows with a third label are left out."""
    t, p = F.col(truth), F.col(pred)
    rows = df.filter(t.isin(positive, negative) & p.isin(positive, negative))
    cell = lambda a, b: F.sum(F.when((t == a) & (p == b), 1).otherwise(0))
    counted = rows.groupBy(*(by or [])).agg(cell(positive, positive).alias("tp"), cell(negative, positive).alias("fp"), cell(positive, negative).alias("fn"), cell(negative, negative).alias("tn"))
    tp, fp, fn, tn = (F.coalesce(F.col(c), F.lit(0)) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    return counted.select(
        *(by or []), n.cast("long").alias("n"), _share(tp + tn, n).alias("accuracy"), _share(tp, tp + fp).alias("precision"), _share(tp, tp + fn).alias("recall"), _f1(tp, fp, fn).alias("f1"),
        *[c.cast("long").alias(name) for c, name in ((tp, "tp"), (fp, "fp"), (fn, "fn"), (tn, "tn"))],
    )


def class_report(df: DataFrame, truth: str, pred: str, labels: tuple[str, ...] | None = None) -> DataFrame:
    """(label, precision, recall, f1, support) of the given labels, or of those that occur."""
    cells = confusion(df.filter(F.col(truth).isNotNull() & F.col(pred).isNotNull()), truth, pred)
    sides = F.array(F.struct(F.col("truth").alias("label"), F.col("n").alias("is"), F.lit(0).cast("long").alias("said")), F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("is"), F.col("n").alias("said")))
    hits = cells.filter(F.col("truth") == F.col("pred")).select(F.col("truth").alias("label"), F.col("n").alias("tp"))
    totals = cells.select(F.explode(sides).alias("s")).groupBy("s.label").agg(F.sum("s.is").alias("support"), F.sum("s.said").alias("said"))
    if labels is not None:
        totals = df.sparkSession.createDataFrame([(x,) for x in labels], "label string").join(totals, "label", "left")
    rows = totals.join(hits, "label", "left").select("label", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tp", "said", "support")])
    tp, said, support = F.col("tp"), F.col("said"), F.col("support")
    return rows.select("label", _share(tp, said).alias("precision"), _share(tp, support).alias("recall"), _f1(tp, said - tp, support - tp).alias("f1"), "support")


def attribute_agreement(df: DataFrame, pairs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(attribute, n, agreement): share of rows whose two winners are the same; rows without a golden winner are left out."""
    cells = F.array(*[F.struct(F.lit(a).alias("attribute"), t.alias("t"), p.alias("p")) for a, (t, p) in pairs.items()])
    rows = df.select(F.explode(cells).alias("c")).select("c.*").filter(F.col("t") != "")
    return rows.groupBy("attribute").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("t") == F.col("p"), 1.0).otherwise(0.0)).alias("agreement"))


def pooled(agreement: DataFrame) -> DataFrame:
    """The mean over attributes."""
    return agreement.agg(F.avg("agreement").alias("agreement"), F.sum("n").cast("long").alias("n"))


def best_by(df: DataFrame, metric: str, name: str) -> DataFrame:
    """The row of the highest metric; ties go to the first name."""
    return df.orderBy(F.col(metric).desc_nulls_last(), F.col(name)).limit(1)


def thresholds(start: float, stop: float, step: float) -> list[float]:
    """A grid of thresholds, both ends included, without drift."""
    return [round(start + i * step, 10) for i in range(int(round((stop - start) / step)) + 1)]


def threshold_sweep(df: DataFrame, score: str, label: str, grid: list[float]) -> DataFrame:
    """(threshold, n, accuracy, balanced_accuracy, f1) of the decision score >= threshold, in one pass.

    Scores are counted by the grid cell they fall in before anything is multiplied by the grid.
    """
    ordered = sorted(grid)
    spot = reduce(lambda a, b: a + b, [F.when(F.col(score) >= t, 1).otherwise(0) for t in ordered])
    cells = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(spot.alias("spot")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"), F.count(F.lit(1)).alias("all"))
    marks = df.sparkSession.createDataFrame([(i + 1, t) for i, t in enumerate(ordered)], "i int, threshold double")
    pairs = cells.crossJoin(F.broadcast(marks))  # at most (grid + 1) x grid rows
    sums = pairs.groupBy("threshold").agg(*[F.sum(F.when(c, F.col(k)).otherwise(0)).alias(name) for name, c, k in (("tp", F.col("spot") >= F.col("i"), "pos"), ("said", F.col("spot") >= F.col("i"), "all"), ("pos", F.lit(True), "pos"), ("n", F.lit(True), "all"))])
    tp, said, pos, n = F.col("tp"), F.col("said"), F.col("pos"), F.col("n")
    tn = n - pos - (said - tp)
    return sums.select("threshold", n.cast("long").alias("n"), _share(tp + tn, n).alias("accuracy"), ((_share(tp, pos) + _share(tn, n - pos)) / 2).alias("balanced_accuracy"), _f1(tp, said - tp, pos - tp).alias("f1"))


def best_threshold(sweep: DataFrame, metric: str) -> DataFrame:
    """The lowest threshold of the highest metric."""
    return sweep.orderBy(F.col(metric).desc(), F.col("threshold")).limit(1)


def running_sums(df: DataFrame, order: str, columns: list[str], descending: bool = False) -> DataFrame:
    """``df`` with run_{c}, the sum of each column up to and with a row, and all_{c}, over rows of distinct ``order``.

    Rows are put into ranges of ``order``; sums run within a range and start at the totals of the ranges before, so no
    task sees more than its range however many rows there are.
    """
    key = F.col(order).desc() if descending else F.col(order).asc()
    ranged = cut_lineage(df.repartitionByRange(key).withColumn("__range", F.spark_partition_id()))
    totals = ranged.groupBy("__range").agg(*[F.sum(c).alias(f"__t_{c}") for c in columns])
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    every = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = totals.select("__range", *[F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__b_{c}") for c in columns], *[F.sum(f"__t_{c}").over(every).alias(f"all_{c}") for c in columns])
    within = Window.partitionBy("__range").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(F.broadcast(starts), "__range")
    return joined.withColumns({f"run_{c}": F.sum(c).over(within) + F.col(f"__b_{c}") for c in columns}).drop("__range", *[f"__b_{c}" for c in columns])


def precision_recall_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, precision, recall, f1) at every distinct score."""
    by = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"), F.count(F.lit(1)).alias("n"))
    run = running_sums(by, "threshold", ["pos", "n"], descending=True)
    tp, said, support = F.col("run_pos"), F.col("run_n"), F.col("all_pos")
    return run.select("threshold", _share(tp, said).alias("precision"), _share(tp, support).alias("recall"), _f1(tp, said - tp, support - tp).alias("f1"))


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """(auc): the rank sum form, ties counting half."""
    by = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"))
    run = running_sums(by, "s", ["neg"]).withColumn("below", F.col("run_neg") - F.col("neg"))
    sums = run.agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("wins"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return sums.select(F.try_divide("wins", F.col("p") * F.col("n")).alias("auc"))


def log_loss(df: DataFrame, score: str, label: str, floor: float = 1e-15) -> DataFrame:
    """(log_loss): mean negative log likelihood, scores kept off 0 and 1."""
    p = F.least(F.greatest(F.col(score), F.lit(floor)), F.lit(1 - floor))
    return df.agg(F.avg(F.when(F.col(label) == 1, -F.log(p)).otherwise(-F.log(1 - p))).alias("log_loss"))


def cascade_sweep(df: DataFrame, p_none: str, refined: str, truth: str, grid: list[float]) -> DataFrame:
    """(threshold, errors): mix-ups of base and none of the cascade at each threshold."""
    cells = df.filter(F.col(p_none).isNotNull()).groupBy(F.floor(F.col(p_none) * 1_000_000).alias("q"), F.col(refined).alias("r"), F.col(truth).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    marks = df.sparkSession.createDataFrame([(t,) for t in sorted(grid)], "threshold double")
    said = F.when(F.col("q") >= F.floor(F.col("threshold") * 1_000_000), "none").otherwise(F.col("r"))
    wrong = ((F.col("t") == "base") & (said == "none")) | ((F.col("t") == "none") & (said == "base"))
    return cells.crossJoin(F.broadcast(marks)).groupBy("threshold").agg(F.sum(F.when(wrong, F.col("n")).otherwise(0)).cast("long").alias("errors"))


def error_reduction(flat: Column, cascaded: Column) -> Column:
    """Share of the flat errors that the cascade avoids."""
    return F.coalesce(F.try_divide((flat - cascaded).cast("double"), flat), F.lit(0.0))


def strategy_agreement(df: DataFrame, attributes: tuple[str, ...], golden: str = "attr_{}_winner", truth: str = "truth_{}_winner") -> DataFrame:
    """(strategy, agreement): always base, always alt and the truth pipeline against golden winners, mean over attributes."""
    cells = []
    for a in attributes:
        g, t = plain(F.col(golden.format(a))), plain(F.col(truth.format(a)))
        for name, said in (("always_base", F.lit("base")), ("always_alt", F.lit("alt")), ("pipeline", F.when(t == "real", "alt").otherwise(t))):
            cells.append(F.struct(F.lit(name).alias("strategy"), F.lit(a).alias("attribute"), g.alias("g"), said.alias("s")))
    rows = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").filter(F.col("g") != "")
    per = rows.groupBy("strategy", "attribute").agg(F.avg(F.when(F.col("g") == F.col("s"), 1.0).otherwise(0.0)).alias("a"))
    return per.groupBy("strategy").agg(F.avg("a").alias("agreement"))


def evaluate_methods(golden: DataFrame, key: str, truth: Column, methods: dict[str, tuple[DataFrame, Column]], labels: tuple[str, ...]) -> DataFrame:
    """Metrics of every method (table of predictions, label expression) against golden, best accuracy first.

    Predictions are joined by key; golden keys that come more than once are kept as often.
    """
    answers = [df.select(F.col(key), said.alias("pred")).withColumn("method", F.lit(name)) for name, (df, said) in methods.items()]
    every = reduce(lambda a, b: a.unionByName(b), answers)
    joined = golden.select(F.col(key), truth.alias("truth")).filter(F.col("truth").isin(*labels)).join(every, key)
    return class_metrics(joined, "truth", "pred", labels, ["method"]).orderBy(F.col("accuracy").desc(), "method")
