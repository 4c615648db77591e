"""Texts packed into containers of fixed capacity.

A text longer than the capacity is cut into full pieces and a rest; no other text is split. Dynamic programming over
the global histogram of piece lengths chooses the bucket boundaries of least padding. Batches of the token budget are
then formed from the buckets: the largest bucket that still has pieces opens a container, and the space left over is
filled from the largest bucket that fits, first its own. (Batches that never leave their bucket cannot fill a container
whose pieces are longer than half of it; ``bucket_only`` gives the figures of that form.) A batch is worked out once for
all the containers that look like it, so the plan has a few hundred lines however many texts there are.

Pieces find their container by their rank in the bucket. Ranks come from counts per slice of a bucket and a window
within the slice; slices are made small enough for one task, whatever share of all texts a bucket holds. The driver
gets the histogram (as many rows as the capacity at most) and the slice counts, both checked.

Defined results: NULL and empty texts take no space and go to container 0; NULL ids are kept. Equal lengths are
ordered by a hash of the id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from pairloom.session import bounded_rows, cut_lineage


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> np.ndarray:
    """Upper ends of at most ``buckets`` buckets of least total padding; each end is one of the sorted ``lengths``."""
    n = len(lengths)
    if n <= buckets:
        return lengths.copy()
    number, mass = np.concatenate(([0], np.cumsum(counts))), np.concatenate(([0], np.cumsum(counts * lengths)))

    def cost(i: np.ndarray, j: int) -> np.ndarray:
        """Padding of one bucket of the lengths i..j-1."""
        return (number[j] - number[i]) * lengths[j - 1] - (mass[j] - mass[i])

    best = cost(np.zeros(n + 1, int), 0).astype(float)
    best = np.array([0.0] + [float(cost(np.array([0]), j)[0]) for j in range(1, n + 1)])
    cut = np.zeros((buckets + 1, n + 1), int)
    for b in range(2, buckets + 1):
        fresh = np.full(n + 1, np.inf)
        fresh[0] = 0.0
        stack = [(1, n, 0, n - 1)]
        while stack:  # the best cut moves with the end, so each half needs its own range only
            low, high, left, right = stack.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = np.arange(left, min(right, j - 1) + 1)
            total = best[i] + cost(i, j)
            at = int(total.argmin())
            fresh[j], cut[b, j] = total[at], i[at]
            stack += [(low, j - 1, left, int(i[at])), (j + 1, high, int(i[at]), right)]
        best = fresh
    ends, j = [], n
    for b in range(buckets, 0, -1):
        if j <= 0:
            break
        ends.append(lengths[j - 1])
        j = cut[b, j] if b > 1 else 0
    return np.array(sorted(set(ends)))


@dataclass
class Plan:
    """Containers of one capacity: bucket ends, and for each bucket the ranks, first container and pieces a container."""

    ends: np.ndarray
    ranks: list[np.ndarray]
    first: list[np.ndarray]
    each: list[np.ndarray]
    n_containers: int


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int, buckets: int = 256) -> Plan:
    """Fill containers with the pieces of a histogram."""
    ends = boundaries(lengths, counts, buckets)
    of = np.searchsorted(ends, lengths)
    left = np.bincount(of, counts, len(ends)).astype(np.int64)
    used = np.zeros(len(ends), np.int64)
    lines: list[list[tuple[int, int, int]]] = [[] for _ in ends]
    containers = 0
    while left.any():
        room, batch = capacity, {}
        free = left.copy()
        i = len(ends) - 1
        while i >= 0:
            fit = min(room // int(ends[i]), int(free[i]))
            if fit:
                batch[i] = int(fit)
                room -= fit * int(ends[i])
                free[i] -= fit
            i = min(i - 1, int(np.searchsorted(ends, room, "right")) - 1)
        times = min(int(left[i]) // n for i, n in batch.items())
        for i, n in batch.items():
            lines[i].append((int(used[i]), containers, n))
            used[i] += n * times
            left[i] -= n * times
        containers += times
    arrays = [np.array(x, np.int64).reshape(-1, 3) for x in lines]
    return Plan(ends, [a[:, 0] for a in arrays], [a[:, 1] for a in arrays], [a[:, 2] for a in arrays], containers)


def bucket_only(lengths: np.ndarray, counts: np.ndarray, capacity: int, buckets: int = 256) -> int:
    """Containers needed if no batch leaves its bucket."""
    ends = boundaries(lengths, counts, buckets)
    left = np.bincount(np.searchsorted(ends, lengths), counts, len(ends)).astype(np.int64)
    return int(sum(-(-int(n) // max(1, capacity // int(e))) for e, n in zip(ends, left, strict=True)))


def _pieces(sized: DataFrame, key: str, size: str, capacities: dict[str, int]) -> DataFrame:
    packs = F.array(*[F.struct(F.lit(name).alias("pack_name"), F.lit(c).cast("long").alias("capacity")) for name, c in sorted(capacities.items())])
    rows = sized.select(key, size, F.explode(packs).alias("p")).select(key, size, "p.pack_name", "p.capacity")
    last = F.greatest(F.floor((F.col(size) - 1) / F.col("capacity")), F.lit(0)).cast("long")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part_no"))
    start = F.col("part_no") * F.col("capacity")
    return rows.select(key, "pack_name", "part_no", start.alias("start_token"), F.least(F.col(size) - start, F.col("capacity")).alias("n_tokens"))


def histograms(sized: DataFrame, key: str, size: str, capacities: dict[str, int]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Lengths and counts of all pieces by pack."""
    rows = _pieces(sized, key, size, capacities).filter("n_tokens > 0").groupBy("pack_name", "n_tokens").agg(F.count(F.lit(1)).alias("n"))
    found = bounded_rows(rows, sum(capacities.values()), "piece lengths")
    out = {}
    for name in capacities:
        mine = sorted((r.n_tokens, r.n) for r in found if r.pack_name == name)
        out[name] = (np.array([x for x, _ in mine], np.int64), np.array([n for _, n in mine], np.int64))
    return out


def pack(sized: DataFrame, key: str, size: str, capacities: dict[str, int], buckets: int = 256, slice_rows: int = 50_000) -> DataFrame:
    """(key, pack_name, part_no, start_token, n_tokens, container_no): the container of every piece in every pack."""
    sized = cut_lineage(sized.select(key, size))
    shapes = histograms(sized, key, size, capacities)
    plans = {name: plan(*shapes[name], capacities[name], buckets) for name in capacities}

    def bucket(names: pd.Series, tokens: pd.Series) -> pd.Series:
        out = np.zeros(len(tokens), np.int64)
        for name, p in plans.items():
            here = (names == name).to_numpy() & (tokens > 0).to_numpy()
            out[here] = np.searchsorted(p.ends, tokens.to_numpy()[here])
        return pd.Series(out)

    slices = {name: np.maximum(1, -(-np.bincount(np.searchsorted(plans[name].ends, x), n, max(len(plans[name].ends), 1)) // slice_rows)) for name, (x, n) in shapes.items()}

    def slice_of(names: pd.Series, buckets_: pd.Series, hashes: pd.Series) -> pd.Series:
        out = np.zeros(len(names), np.int64)
        for name, n in slices.items():
            here = (names == name).to_numpy()
            out[here] = hashes.to_numpy()[here] % n[buckets_.to_numpy()[here]].astype(np.int64)
        return pd.Series(out)

    rows = _pieces(sized, key, size, capacities)
    rows = rows.withColumn("bucket", F.pandas_udf(bucket, LongType())("pack_name", "n_tokens"))
    rows = rows.withColumn("slice", F.pandas_udf(slice_of, LongType())("pack_name", "bucket", F.xxhash64(key, "part_no")))
    some, none = rows.filter("n_tokens > 0"), rows.filter("n_tokens <= 0")
    counts = some.groupBy("pack_name", "bucket", "slice").agg(F.count(F.lit(1)).alias("n"))
    offsets: dict[str, dict[tuple[int, int], int]] = {name: {} for name in capacities}
    seen: dict[tuple[str, int], int] = {}
    for r in sorted(bounded_rows(counts, 5_000_000, "slices of buckets")):
        offsets[r.pack_name][(r.bucket, r.slice)] = seen.get((r.pack_name, r.bucket), 0)
        seen[(r.pack_name, r.bucket)] = seen.get((r.pack_name, r.bucket), 0) + r.n
    window = Window.partitionBy("pack_name", "bucket", "slice").orderBy(F.xxhash64(key, "part_no"), key, "part_no")
    some = some.withColumn("rank", F.row_number().over(window) - 1)

    def container(names: pd.Series, buckets_: pd.Series, slices_: pd.Series, ranks: pd.Series) -> pd.Series:
        out = np.zeros(len(names), np.int64)
        frame = pd.DataFrame({"p": names, "b": buckets_, "s": slices_, "r": ranks}).reset_index(drop=True)
        for (name, b, s), group in frame.groupby(["p", "b", "s"]):
            p, rank = plans[name], group["r"].to_numpy() + offsets[name][(b, s)]
            line = np.searchsorted(p.ranks[b], rank, "right") - 1
            out[group.index] = p.first[b][line] + (rank - p.ranks[b][line]) // p.each[b][line]
        return pd.Series(out)

    some = some.withColumn("container_no", F.pandas_udf(container, LongType())("pack_name", "bucket", "slice", "rank"))
    columns = [key, "pack_name", "part_no", "start_token", "n_tokens", "container_no"]
    return some.select(columns).unionByName(none.withColumn("container_no", F.lit(0).cast("long")).select(columns))
