"""One winner per item from annotators who disagree: latent ability and difficulty by gradient EM.

An annotator of ability a gives an item of difficulty 1/b the right label with probability s = sigmoid(a b), any other
with (1 - s) / (K - 1). The E step finds label posteriors, the M step climbs the gradient in a and log b, both with a
normal prior. Two things that opinions show are modelled on top. An annotator may use the labels in other roles
(habitually swapped ones): the permutation that explains the labels best is found from the expected confusion and
undone where it is clear. Annotators may copy: where one errs, judged by the others alone, the other's share of the
same error beyond chance is their dependence, and of two agreeing opinions the dependent one counts for what is left.

Items lie in partitions with all their labels, of which there are as many as annotators at most. Each pass sends
abilities out and gets sums per annotator back; difficulties are found within the pass, on flat arrays of whole batches.
Passes end when no ability moves any more. Abilities, sums and the pairs of annotators that meet often are all that
reaches the driver; annotators and pairs are checked against ``max_annotators`` and ``max_pairs``.

Defined results: labels that say nothing, and rows without item or annotator, are no opinions; equal repeated opinions
count once, of different ones of one annotator on one item the last by ``at`` counts, of ties the first label. Items
without opinions have no row. Ties of posteriors fall to the first label in ``labels``.
"""

from __future__ import annotations

import itertools
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.session import bounded_rows, cut_lineage

#: The ways a winner is written.
WINNER_FORMS = {"a": "alt", "m": "alt", "match": "alt", "alt": "alt", "b": "base", "base": "base", "t": "both", "both": "both", "none": "none"}
LABELS = ("alt", "base", "both", "none")


def winner(c: Column) -> Column:
    """A winner in its plain form; what says nothing is NULL."""
    plain = F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    found = F.lit(None).cast("string")
    for form, label in WINNER_FORMS.items():
        found = F.when(plain == form, label).otherwise(found)
    return found


@dataclass
class Model:
    """What is known of annotators; arrays go by the number of an annotator in ``names``."""

    labels: tuple[str, ...]
    names: list[str] = field(default_factory=list)
    prior: np.ndarray = field(default_factory=lambda: np.ones(0))
    abilities: np.ndarray = field(default_factory=lambda: np.ones(0))
    meanings: np.ndarray = field(default_factory=lambda: np.ones((0, 0), int))
    counts: np.ndarray = field(default_factory=lambda: np.ones(0))
    #: (annotator, other, dependence): the annotator's opinions that agree with the other's count for what is left
    copies: list[tuple[int, int, float]] = field(default_factory=list)

    @property
    def ability(self) -> dict[str, float]:
        return dict(zip(self.names, self.abilities.tolist(), strict=True))

    @property
    def roles(self) -> dict[str, tuple[int, ...]]:
        return {name: tuple(r) for name, r in zip(self.names, self.meanings.tolist(), strict=True)}

    @property
    def depends(self) -> dict[tuple[str, str], float]:
        return {(self.names[a], self.names[b]): v for a, b, v in self.copies}


def gathered(opinions: DataFrame, item: list[str]) -> DataFrame:
    """(item, annotators, given): each item with its opinions, one per annotator; ``opinions`` has annotator, label, at."""
    said = opinions.filter(F.col("label").isNotNull() & F.col("annotator").isNotNull())
    for c in item:
        said = said.filter(F.col(c).isNotNull())
    last = said.groupBy(*item, "annotator").agg(F.max(F.struct(F.coalesce(F.col("at"), F.lit("1900-01-01").cast("timestamp")).alias("at"), "label")).alias("o"))
    return last.groupBy(*item).agg(F.sort_array(F.collect_list(F.struct("annotator", F.col("o.label").alias("label")))).alias("said"))


@dataclass
class Flat:
    """Opinions of a batch: item, annotator, label and what it is taken to mean, by number, and the weight left by copies."""

    n: int
    item: np.ndarray
    who: np.ndarray
    label: np.ndarray
    meant: np.ndarray
    ability: np.ndarray
    weight: np.ndarray


def _flat(batch: pa.RecordBatch, model: Model, numbers: dict[str, int]) -> Flat:
    """The opinions of a batch as arrays; strings are looked up once per distinct one."""
    said = batch.column(batch.schema.get_field_index("said"))
    index = {label: k for k, label in enumerate(model.labels)}
    parts = said.flatten()

    def coded(name: str, known: dict[str, int]) -> np.ndarray:
        column = parts.field(name).dictionary_encode()
        values = np.array([known.get(x, -1) for x in column.dictionary.to_pylist()] or [-1])
        return values[column.indices.to_numpy(zero_copy_only=False)] if len(column) else np.zeros(0, int)

    item = np.repeat(np.arange(len(said)), said.value_lengths().to_numpy(zero_copy_only=False)) if len(said) else np.zeros(0, int)
    who, label = coded("annotator", numbers), coded("label", index)
    there = (who >= 0) & (label >= 0)
    item, who, label = item[there], who[there], label[there]
    weight = np.ones(len(item))
    if model.copies and len(item):
        order = np.argsort(who, kind="stable")
        edges = np.searchsorted(who[order], np.arange(len(model.names) + 1))
        of = lambda a: order[edges[a] : edges[a + 1]]
        for a, b, share in model.copies:
            if (model.counts[b], -b) > (model.counts[a], -a):
                _, x, y = np.intersect1d(item[of(a)], item[of(b)], assume_unique=True, return_indices=True)
                x, y = of(a)[x], of(b)[y]
                weight[x[label[x] == label[y]]] *= 1 - share
    return Flat(len(said), item, who, label, model.meanings[who, label], model.abilities[who], weight)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def posteriors(n: int, item: np.ndarray, ability: np.ndarray, meant: np.ndarray, weight: np.ndarray, prior: np.ndarray, rounds: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Label posteriors and log ease of n items by EM at given abilities (one per opinion)."""
    k = len(prior)
    ease = np.zeros(n)
    q = np.tile(prior, (n, 1))
    for turn in range(rounds):
        s = _sigmoid(ability * np.exp(ease[item]))
        score = np.tile(np.log(prior), (n, 1))
        low = weight * np.log((1 - s) / (k - 1) + 1e-12)
        score += np.bincount(item, low, n)[:, None]
        score += np.bincount(item * k + meant, weight * np.log(s + 1e-12) - low, n * k).reshape(n, k)
        q = np.exp(score - score.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        if turn < rounds - 1:
            right = q[item, meant]
            for _ in range(3):
                scale = ability * np.exp(ease[item])
                s = _sigmoid(scale)
                slope = np.bincount(item, weight * (right - s) * scale, n) - ease
                bend = np.bincount(item, weight * s * (1 - s) * scale**2, n) + 1
                ease = np.clip(ease + np.clip(slope / bend, -1, 1), -3, 3)
    return q, ease


def _sums(items: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over all items at the current model: slope, bend and number of opinions [annotator, 3], expected confusion
    [annotator, label, truth] and expected truths."""
    k, n_names = len(model.labels), len(model.names)
    width = 3 + k * k
    schema = "who int, " + ", ".join(f"v{i} double" for i in range(width))
    sent = items.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        numbers = {x: i for i, x in enumerate(model.names)}
        total = np.zeros((n_names + 1, width))
        for batch in batches:
            f = _flat(batch, model, numbers)
            if not len(f.item):
                continue
            q, ease = posteriors(f.n, f.item, f.ability, f.meant, f.weight, model.prior)
            scale = np.exp(ease[f.item])
            s = _sigmoid(f.ability * scale)
            # An opinion that stands nearly alone on its item tells nothing of its annotator and would only slow EM down.
            telling = f.weight * (np.bincount(f.item, f.weight, f.n)[f.item] - f.weight >= 1.5)
            cells = (telling * (q[f.item, f.meant] - s) * scale, telling * s * (1 - s) * scale**2, np.ones(len(s)))
            for i, values in enumerate(cells):
                total[:n_names, i] += np.bincount(f.who, values, n_names)
            place = f.who * k + f.label
            for j in range(k):
                total[:n_names, 3 + j :: k] += np.bincount(place, q[f.item, j], n_names * k).reshape(n_names, k)
            said = np.bincount(f.item, minlength=f.n) > 0
            total[n_names, 3 : 3 + k] += q[said].sum(0)
        some = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *[pa.array(total[some, i]) for i in range(width)]], ["who", *[f"v{i}" for i in range(width)]])

    rows = items.select("said").mapInArrow(run, schema).groupBy("who").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(width)])
    out = np.zeros((n_names + 1, width))
    for r in bounded_rows(rows, n_names + 1, "annotators"):
        out[r[0]] = r[1:]
    return out[:n_names, :3], out[:n_names, 3:].reshape(n_names, k, k), out[n_names, 3 : 3 + k]


def _roles(confusion: np.ndarray) -> tuple[int, ...]:
    """What each label means, from expected counts [label, truth]: another order only where it is clear."""
    k = len(confusion)
    plain, total = float(np.trace(confusion)), float(confusion.sum())
    best = max(itertools.permutations(range(k)), key=lambda p: sum(confusion[i, p[i]] for i in range(k)))
    found = sum(confusion[i, best[i]] for i in range(k))
    return best if total >= 20 and found > 0.5 * total and plain < 0.3 * total else tuple(range(k))


def _pairs_of_opinions(item: np.ndarray, most: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All ordered pairs of different opinions on one item, as positions; items of like many opinions side by side."""
    starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, len(item)])
    for m in np.unique(sizes[sizes > 1]):
        x, y = np.nonzero(~np.eye(m, dtype=bool))
        mine = starts[sizes == m]
        step = max(1, most // len(x))
        for low in range(0, len(mine), step):
            at = mine[low : low + step, None]
            yield (at + x).ravel(), (at + y).ravel()


def _dependence(items: DataFrame, model: Model, sharp: float = 0.95, least: float = 20.0, max_pairs: int = 1_000_000) -> list[tuple[int, int, float]]:
    """Share of an annotator's errors, as the others alone see them, that another makes as well, beyond chance."""
    n_names = len(model.names)
    sent = items.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        numbers = {x: i for i, x in enumerate(model.names)}
        k = len(model.labels)
        for batch in batches:
            f = _flat(batch, model, numbers)
            s = _sigmoid(f.ability)
            # A decided item's ease speaks for the labels that decided it, so errors are judged at middling ease.
            low = np.log((1 - s) / (k - 1) + 1e-12)
            high = np.log(s + 1e-12) - low
            score = np.log(model.prior) + np.bincount(f.item * k + f.meant, high, f.n * k).reshape(f.n, k)  # what all share falls out
            for x, y in _pairs_of_opinions(f.item):
                rest = score[f.item[x]]
                rows = np.arange(len(x))
                rest[rows, f.meant[x]] -= high[x]
                rest[rows, f.meant[y]] -= high[y]
                p = np.exp(rest - rest.max(1, keepdims=True))
                wrong = 1 - p[rows, f.meant[x]] / p.sum(1) >= sharp
                x, y = x[wrong], y[wrong]
                keys, back = np.unique(f.who[x].astype(np.int64) * n_names + f.who[y], return_inverse=True)
                shared = np.bincount(back, f.meant[x] == f.meant[y], len(keys)) if len(keys) else np.zeros(0)
                count = np.bincount(back, minlength=len(keys)).astype(float) if len(keys) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(count), pa.array(shared.astype(float))], ["pair", "wrong", "shared"])

    pairs = items.select("said").mapInArrow(run, "pair long, wrong double, shared double").groupBy("pair").agg(F.sum("wrong").alias("wrong"), F.sum("shared").alias("shared")).filter(F.col("wrong") >= least)
    found = []
    for r in sorted(bounded_rows(pairs, max_pairs, "pairs of annotators")):
        a, b = divmod(r.pair, n_names)
        accuracy = float(_sigmoid(model.abilities[b : b + 1])[0])
        chance = (1 - accuracy) / (len(model.labels) - 1)
        excess = (r.shared / r.wrong - chance) / (1 - chance)
        if excess > 0.5 and r.shared > r.wrong * chance + 5 * (r.wrong * chance * (1 - chance)) ** 0.5 + 2:
            found.append((a, b, min(float(excess), 0.98)))
    return found


def fit(items: DataFrame, labels: tuple[str, ...] = LABELS, tolerance: float = 0.02, most_passes: int = 40, stages: int = 3, max_annotators: int = 100_000) -> Model:
    """Learn the model from ``items`` (see ``gathered``), which are read once a pass and should be written before.

    A stage ends when no ability moves by ``tolerance`` or more, roles and dependence are looked at again between
    stages, and the last stage is the one after which they stand or the ``stages``-th. A warning tells if a stage did
    not settle within ``most_passes``.
    """
    k = len(labels)
    names = sorted(r[0] for r in bounded_rows(items.select(F.explode("said.annotator")).distinct(), max_annotators, "annotators"))
    n = len(names)
    model = Model(labels, names, np.full(k, 1 / k), np.ones(n), np.tile(np.arange(k), (n, 1)), np.zeros(n))
    if not n:
        return model
    for stage in range(stages):
        for _ in range(most_passes):
            sums, confusion, truths = _sums(items, model)
            model.prior = (truths + 1) / (truths.sum() + k)
            step = (sums[:, 0] - (model.abilities - 1)) / (sums[:, 1] + 1)
            fresh = np.clip(model.abilities + np.clip(step, -1, 1), -6, 6)
            moved = float(np.abs(fresh - model.abilities).max())
            model.abilities, model.counts = fresh, confusion.sum((1, 2)).round()
            if moved < tolerance:
                break
        else:
            warnings.warn(f"abilities still move by {moved:.3f} after {most_passes} passes", stacklevel=2)
        if stage == stages - 1:
            break
        roles = np.array([_roles(c) for c in confusion])
        turned = (roles != model.meanings).any(1)
        model.meanings, model.abilities = roles, np.where(turned, 1.0, model.abilities)
        copies = _dependence(items, model)
        settled = not turned.any() and [c[:2] for c in copies] == [c[:2] for c in model.copies]
        model.copies = copies
        if settled:
            break
    return model


def decide(items: DataFrame, item: list[str], model: Model) -> DataFrame:
    """(item, winner, posterior, difficulty, n_annotators, agreement): the consensus on every item.

    ``agreement`` is the share of agreeing pairs of opinions, corrected for chance by the labels' overall shares; NULL
    with fewer than two opinions.
    """
    chance = float((model.prior**2).sum())
    types = dict(items.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in item) + ", winner string, posterior double, difficulty double, n_annotators int, agreement double"
    sent = items.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        numbers = {x: i for i, x in enumerate(model.names)}
        names, k = np.array(model.labels, dtype=object), len(model.labels)
        for batch in batches:
            f = _flat(batch, model, numbers)
            if not len(f.item):
                continue
            q, ease = posteriors(f.n, f.item, f.ability, f.meant, f.weight, model.prior, rounds=8)
            of_label = np.bincount(f.item * k + f.label, minlength=f.n * k).reshape(f.n, k)
            count = of_label.sum(1)
            pairs = count * (count - 1)
            agree = ((of_label * (of_label - 1)).sum(1) / np.maximum(pairs, 1) - chance) / (1 - chance)
            there = np.flatnonzero(count)
            keys = [batch.column(batch.schema.get_field_index(c)).take(pa.array(there)) for c in item]
            cells = [pa.array(names[q.argmax(1)[there]], pa.string()), pa.array(q.max(1)[there]), pa.array(np.exp(-ease)[there]), pa.array(count[there].astype(np.int32)), pa.array(agree[there], mask=(pairs == 0)[there])]
            yield pa.RecordBatch.from_arrays([*keys, *cells], [*item, "winner", "posterior", "difficulty", "n_annotators", "agreement"])

    return items.select(*item, "said").mapInArrow(run, schema)


def reliabilities(items: DataFrame, consensus: DataFrame, item: list[str], model: Model) -> DataFrame:
    """(annotator, n_labels, ability, accuracy, kappa, roles, copies): what is known of every annotator.

    ``accuracy`` and ``kappa`` compare labels with the consensus; ``roles`` tells what the labels are taken to mean if
    not themselves; ``copies`` names the annotator depended on most.
    """
    spark = items.sparkSession
    plain = tuple(range(len(model.labels)))
    rows = []
    for i, name in enumerate(model.names):
        roles = tuple(model.meanings[i].tolist())
        told = None if roles == plain else ", ".join(f"{model.labels[x]}={model.labels[y]}" for x, y in enumerate(roles) if x != y)
        copied = [(v, model.names[b]) for a, b, v in model.copies if a == i and (model.counts[b], -b) > (model.counts[a], -a)]
        rows.append((name, float(model.abilities[i]), told, max(copied)[1] if copied else None))
    known = spark.createDataFrame(rows, "annotator string, ability double, roles string, copies string")
    said = items.select(*item, F.explode("said").alias("s")).select(*item, "s.annotator", "s.label").join(consensus.select(*item, "winner"), item)
    cells = said.groupBy("annotator", "label", "winner").agg(F.count(F.lit(1)).alias("n"))
    of_label = cells.groupBy("annotator", "label").agg(F.sum("n").alias("nl"))
    of_winner = cells.groupBy("annotator", F.col("winner").alias("label")).agg(F.sum("n").alias("nw"))
    total = cells.groupBy("annotator").agg(F.sum("n").alias("n_labels"), F.sum(F.when(F.col("label") == F.col("winner"), F.col("n")).otherwise(0)).alias("hits"))
    chance = of_label.join(of_winner, ["annotator", "label"]).groupBy("annotator").agg(F.sum(F.col("nl") * F.col("nw")).alias("both"))
    out = total.join(chance, "annotator", "left").join(known, "annotator", "left")
    po, pe = F.col("hits") / F.col("n_labels"), F.coalesce("both", F.lit(0)) / (F.col("n_labels") * F.col("n_labels"))
    return out.select("annotator", F.col("n_labels").cast("long").alias("n_labels"), "ability", po.alias("accuracy"), F.try_divide(po - pe, 1 - pe).alias("kappa"), "roles", "copies")
