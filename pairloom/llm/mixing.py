"""Records of several sources combined so that each gives its target share of the tokens.

Shares are budgets of the leaves of a domain-language-source tree. A source has a leaf in every domain and language it
has records of, and its share is split among them by the tokens it holds there. A budget beyond what a subtree can give
(its tokens times the repeats allowed) is a shortage: within a node it goes to the siblings first, in proportion to
their weights, and only what the whole subtree cannot give reaches the ancestor's other children. A leaf's budget is
spent in epochs: whole passes over its records, then the prefix of one more seeded order that comes nearest to the rest.

The prefix is found from token sums per range of the seeded hash, 256 ranges a pass; the range in which the budget ends
is cut again until it is small, and only its records are put in order. The driver gets one row per leaf and range.

Defined results: records of no target source, NULL sources and ids are listed with 0 repeats (NULL ids too); sources are
compared without case and surrounding space, languages without region; records without tokens are taken in every whole
epoch; ties of the hash go by id. A target source without records gets nothing, its share goes to the others.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.session import bounded_rows, broadcast_within, cut_lineage


@dataclass
class Node:
    """A node of the tree: a leaf has tokens to give, any other has children."""

    name: str
    weight: float = 0.0
    give: float = 0.0
    children: dict[str, Node] = field(default_factory=dict)

    def settle(self) -> None:
        """Weights and supply of inner nodes from their children."""
        for child in self.children.values():
            child.settle()
        if self.children:
            self.weight = sum(c.weight for c in self.children.values())
            self.give = sum(c.give for c in self.children.values())


def share_out(node: Node, budget: float, into: dict[str, float]) -> None:
    """Budgets of all leaves under ``node``; the node itself can give ``budget``."""
    if not node.children:
        into[node.name] = budget
        return
    open_, left, amounts = list(node.children.values()), budget, {}
    while open_:
        weight = sum(c.weight for c in open_)
        want = {c.name: left * (c.weight / weight if weight else 1 / len(open_)) for c in open_}
        short = [c for c in open_ if want[c.name] > c.give + 1e-9]
        if not short:
            amounts |= want
            break
        for c in short:
            amounts[c.name] = c.give
            left -= c.give
        open_ = [c for c in open_ if c not in short]
    for c in node.children.values():
        share_out(c, amounts.get(c.name, 0.0), into)


def tree(leaves: list[tuple[str, str, str, float, float]]) -> Node:
    """The tree of (domain, language, source, weight, tokens it can give); leaves are named domain/language/source."""
    root = Node("(all)")
    for domain, language, source, weight, give in leaves:
        at = root.children.setdefault(domain, Node(domain)).children.setdefault(language, Node(f"{domain}/{language}"))
        at.children[source] = Node(f"{domain}/{language}/{source}", weight, give)
    root.settle()
    return root


def plain_source(column: str) -> Column:
    """A source without case and surrounding space."""
    return F.lower(F.trim(F.col(column)))


LEAF = ("domain", "lang", "source")

#: The range in which the rest of a leaf ends that is taken whole.
WHOLE = 2**62


def _prefix(depth: int) -> Column:
    """The first ``depth`` bits of the hash ``h``."""
    return F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0).cast("long")


def _edges(rows: DataFrame, rest: dict[tuple[str, ...], float], small: int, max_leaves: int) -> tuple[dict[tuple[str, ...], tuple[int, float]], int]:
    """By leaf the range of the hash in which its rest ends and the tokens left for that range, and the bits of ranges.

    A leaf without rest has range -1, one that is taken whole a range beyond all. All leaves are cut until the largest
    range has at most ``small`` records.
    """
    spark = rows.sparkSession
    edges, depth = {k: (0 if r > 0 else -1, r) for k, r in rest.items()}, 0
    while True:
        told = spark.createDataFrame([(*k, e) for k, (e, _) in edges.items()], "domain string, lang string, source string, edge long")
        inside = rows.join(broadcast_within(told, max_leaves), [*LEAF]).filter(_prefix(depth) == F.col("edge"))
        depth += 8
        sums = inside.groupBy(*LEAF, _prefix(depth).alias("range")).agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
        ranges: dict[tuple[str, ...], list[tuple[int, int, int]]] = defaultdict(list)
        for r in bounded_rows(sums, max_leaves * 256, "ranges of leaves"):
            ranges[(r.domain, r.lang, r.source)].append((r.range, r.t, r.n))
        largest = 0
        for k, (edge, room) in edges.items():
            if edge in (-1, WHOLE):
                continue
            at = WHOLE
            for next_, t, n in sorted(ranges[k]):
                if t > room:
                    at, largest = next_, max(largest, n)
                    break
                room -= t
            edges[k] = (at, room)
        if largest <= small or depth >= 48:
            return edges, depth


def mix(records: DataFrame, targets: DataFrame, total: float | None = None, fill: float | None = None, seed: int = 42, max_sources: int = 1_000, max_leaves: int = 20_000, small: int = 20_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Repeats per record, shares per source and budgets per leaf.

    ``records`` has doc_id, source, lang, domain, n_tokens; ``targets`` source, target_share, max_repeats. Without
    ``total`` (tokens) or ``fill`` (multiple of the tokens held) the mix is as large as it can be with every share met.
    """
    spark = records.sparkSession
    wanted = {r.source.strip().lower(): (float(r.target_share), int(r.max_repeats)) for r in bounded_rows(targets.filter(F.col("source").isNotNull()), max_sources, "target sources")}
    language = F.lower(F.substring_index(F.coalesce("lang", F.lit("")), "-", 1))
    plain = records.select("doc_id", plain_source("source").alias("source"), language.alias("lang"), F.coalesce("domain", F.lit("")).alias("domain"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))
    plain = cut_lineage(plain)
    by = plain.filter(F.col("source").isin(*wanted)).groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"))
    held = {(r.domain, r.lang, r.source): int(r.tokens) for r in bounded_rows(by, max_leaves, "leaves")}
    of_source: dict[str, int] = defaultdict(int)
    for (_, _, s), t in held.items():
        of_source[s] += t
    leaves = [(*k, wanted[k[2]][0] * t / of_source[k[2]] if of_source[k[2]] else 0.0, float(t * wanted[k[2]][1])) for k, t in sorted(held.items())]
    root = tree(leaves)
    reach = [of_source[s] * repeats / w for s, (w, repeats) in wanted.items() if w > 0 and of_source[s] > 0]
    size = total if total is not None else fill * sum(of_source.values()) if fill is not None else min(reach, default=0.0)
    into: dict[str, float] = {}
    share_out(root, min(size, root.give), into)
    budgets = {k: into.get("/".join(k), 0.0) for k in held}
    epochs = {k: min(int(budgets[k] / t + 1e-12), wanted[k[2]][1]) if t else 0 for k, t in held.items()}
    rest = {k: budgets[k] - epochs[k] * t if t and epochs[k] < wanted[k[2]][1] else 0.0 for k, t in held.items()}

    known = spark.createDataFrame([(*k, epochs[k]) for k in held], "domain string, lang string, source string, epoch int")
    rows = plain.join(broadcast_within(known, max_leaves), [*LEAF], "left").withColumn("h", F.xxhash64("doc_id", F.lit(seed), F.col("epoch")))
    edges, depth = _edges(rows.filter(F.col("epoch").isNotNull()), rest, small, max_leaves)
    told = spark.createDataFrame([(*k, *edges[k]) for k in held], "domain string, lang string, source string, edge long, room double")
    rows = rows.join(broadcast_within(told, max_leaves), [*LEAF], "left").withColumn("range", _prefix(depth))
    whole = rows.filter(F.coalesce(F.col("range") != F.col("edge"), F.lit(True))).withColumn("more", F.when(F.col("range") < F.col("edge"), 1).otherwise(0))
    edge = rows.filter(F.col("range") == F.col("edge"))
    running = F.sum("n_tokens").over(Window.partitionBy(*LEAF).orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    edge = edge.withColumn("more", F.when(running - F.col("n_tokens") / 2 <= F.col("room"), 1).otherwise(0))
    count = F.coalesce("epoch", F.lit(0)) + F.when(F.col("epoch").isNotNull(), F.col("more")).otherwise(0)
    repeats = cut_lineage(whole.unionByName(edge).select("doc_id", *LEAF, "n_tokens", count.cast("int").alias("repeats")))
    got = repeats.groupBy(*LEAF).agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens_taken"), F.max("repeats").alias("most_repeats"), F.sum((F.col("repeats") > 0).cast("long")).alias("n_docs"))
    planned = spark.createDataFrame([(*leaf[:4], held[leaf[:3]], float(budgets[leaf[:3]])) for leaf in leaves], "domain string, lang string, source string, weight double, tokens_held long, budget double")
    by_leaf = cut_lineage(planned.join(got, [*LEAF], "left").select(*LEAF, "weight", "tokens_held", "budget", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens_taken", "most_repeats", "n_docs")]))
    sums = by_leaf.groupBy("source").agg(*[F.sum(c).alias(c) for c in ("n_docs", "tokens_held", "tokens_taken", "budget")], F.max("most_repeats").alias("most_repeats"))
    asked = spark.createDataFrame([(s, w, r) for s, (w, r) in wanted.items()], "source string, target_share double, max_repeats int")
    everything = by_leaf.agg(F.sum("tokens_taken")).first()[0] or 1
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    shares = asked.join(sums, "source", "left").select("source", "target_share", (F.coalesce("tokens_taken", F.lit(0)) / F.lit(float(everything))).alias("actual_share"), "max_repeats", zero("most_repeats"), zero("n_docs"), zero("tokens_held"), zero("tokens_taken"), F.coalesce("budget", F.lit(0.0)).alias("budget"))
    return repeats.select("doc_id", "source", "n_tokens", "repeats"), shares, by_leaf
