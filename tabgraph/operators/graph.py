"""Graphs from similarities, and their structure.

A :class:`Graph` keeps the factored form: links between classes, a link a = a
making the members of a class all neighbours. A plain edge list is the special
case of one class per node, so every metric has one implementation.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabgraph.distributed import materialize, ordered_index, running_totals, with_scalars
from tabgraph.functions.numbers import bound, l2_normalize, log_degree_bin, one_hot, standard_scale
from tabgraph.operators.mixtures import combine_pruned
from tabgraph.operators.similarity import Similarity, Vectors, closeness, expand_pairs

#: Counts of node pairs pass 64 bits from 3 x 10^9 nodes on.
PAIRS = "decimal(38,0)"


def product(x: str, y: str) -> Column:
    """Product of two counts beyond 64 bits."""
    return (F.col(x).cast("decimal(19,0)") * F.col(y).cast("decimal(19,0)")).cast(PAIRS)


#: Thresholds are multiples of 1 / SCALE: the bisection interval stays above 1e-6 that long.
SCALE = 1 << 20


@dataclass(frozen=True)
class Graph:
    """members: (node_id, cls). links: (a, b), both directions, a = b for a clique."""

    members: DataFrame
    links: DataFrame

    @staticmethod
    def from_edges(nodes: DataFrame, edges: DataFrame, node: str = "node_id") -> "Graph":
        """From an edge list (src, dst) with both directions; loops are dropped."""
        members = nodes.select(F.col(node).alias("node_id"), F.col(node).alias("cls"))
        links = edges.filter("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
        return Graph(members, links)

    @staticmethod
    def above(similarity: Similarity, threshold: float) -> "Graph | CosineGraph":
        """G4 in factored form: link where sim > threshold. Links of vectors are found, not stored."""
        kept = above(similarity, threshold)
        if similarity.vectors is not None:
            return CosineGraph(similarity.vectors, threshold)
        forth = F.struct(F.col("a").alias("a"), F.col("b").alias("b"))
        back = F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
        ways = F.when(F.col("a") == F.col("b"), F.array(forth)).otherwise(F.array(forth, back))
        return Graph(similarity.members, kept.select(F.inline(ways)))

    def materialized(self) -> "Graph":
        """Links computed once, for consumers that read them several times."""
        return Graph(self.members, materialize(self.links))

    def sizes(self) -> DataFrame:
        return self.members.groupBy("cls").agg(F.count(F.lit(1)).alias("m"))

    def class_degrees(self) -> DataFrame:
        """(cls, deg, clique): neighbours of each member, and whether its own class is linked."""
        reach = self.links.join(self.sizes().withColumnRenamed("cls", "b"), "b")
        return reach.groupBy(F.col("a").alias("cls")).agg(
            F.sum(F.when(F.col("a") == F.col("b"), F.col("m") - 1).otherwise(F.col("m"))).alias("deg"),
            F.max(F.col("a") == F.col("b")).alias("clique"),
        )

    def linked_totals(self, per_class: DataFrame, columns: list[str]) -> DataFrame:
        """(cls, columns...): sums over all classes linked to a class, itself included if it is a clique."""
        sent = self.links.join(per_class.select(F.col("cls").alias("b"), *columns), "b")
        return sent.groupBy(F.col("a").alias("cls")).agg(*[F.sum(c).alias(c) for c in columns])

    def label_totals(self, counts: DataFrame) -> DataFrame:
        """(cls, y_dst, n, own): for counts (cls, y, n), how many nodes of each label the classes linked to a
        class hold, and whether its own class is among them."""
        met = self.links.join(counts.withColumnsRenamed({"cls": "b", "y": "y_dst"}), "b")
        return met.groupBy(F.col("a").alias("cls"), "y_dst").agg(
            F.sum("n").alias("n"), F.max(F.col("a") == F.col("b")).alias("own"))

    def label_mixing(self, counts: DataFrame) -> DataFrame:
        """(y_src, y_dst, n): directed links between the nodes counted as (cls, y, n)."""
        return _label_mixing(self, counts)


def _label_mixing(graph: "Graph | IntervalGraph", counts: DataFrame) -> DataFrame:
    met = graph.label_totals(counts).join(counts.withColumnsRenamed({"y": "y_src", "n": "n_a"}), "cls")
    # A node is no neighbour of its own.
    own = (F.col("own") & (F.col("y_src") == F.col("y_dst"))).cast("long")
    return met.groupBy("y_src", "y_dst").agg(F.sum(F.col("n_a") * (F.col("n") - F.coalesce(own, F.lit(0)))).alias("n"))


@dataclass(frozen=True)
class CosineGraph:
    """Graph of vectors linked where their cosine exceeds a threshold.

    No link is stored: blocks of distinct vectors are multiplied, and degrees, sums over neighbours and
    label counts leave a block as such. What travels grows with the vectors times the blocks they meet,
    not with the links.
    """

    vectors: Vectors
    threshold: float

    @property
    def members(self) -> DataFrame:
        return self.vectors.members

    @property
    def links(self) -> DataFrame:
        """For consumers that need every link: both directions, a = b for a clique."""
        pairs = self.vectors.class_pairs(self.threshold)
        ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
        return pairs.select(F.inline(ways)).unionByName(self._inside().links)

    def materialized(self) -> "CosineGraph":
        return replace(self, vectors=self.vectors.materialized())

    def _inside(self) -> Graph:
        """Only the links inside classes of two or more."""
        groups = self.vectors.groups.filter((F.col("m") > 1) & F.lit(self.threshold < 1.0))
        return Graph(self.members, groups.select(F.col("cls").alias("a"), F.col("cls").alias("b")))

    def sizes(self) -> DataFrame:
        return self.members.groupBy("cls").agg(F.count(F.lit(1)).alias("m"))

    def class_degrees(self) -> DataFrame:
        sizes = self.vectors.groups.select("cls", F.array(F.col("m").cast("double")).alias("x"))
        across = self.vectors.linked_sums(sizes, 1, self.threshold).select(
            "cls", F.col("x0").cast("long").alias("deg"), F.lit(False).alias("clique"))
        return across.unionByName(self._inside().class_degrees()).groupBy("cls").agg(
            F.sum("deg").alias("deg"), F.max("clique").alias("clique")).filter("deg > 0")

    def linked_totals(self, per_class: DataFrame, columns: list[str]) -> DataFrame:
        asked = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
        across = self.vectors.linked_sums(per_class.select("cls", asked.alias("x")), len(columns), self.threshold)
        across = across.select("cls", *[F.col(f"x{i}").alias(c) for i, c in enumerate(columns)])
        return across.unionByName(self._inside().linked_totals(per_class, columns)).groupBy("cls").agg(
            *[F.sum(c).alias(c) for c in columns])

    def label_mixing(self, counts: DataFrame) -> DataFrame:
        across = self.vectors.linked_labels(counts, self.threshold)
        return across.unionByName(self._inside().label_mixing(counts)).groupBy("y_src", "y_dst").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class IntervalGraph:
    """Graph of one number: nodes are linked where 1 / (1 + |difference|) exceeds a threshold.

    No link is stored. The neighbours of a value are one range of the sorted values, so degrees, label
    counts and sums over neighbours are differences of running totals: n log n at any density, where
    a table of links would hold a row per pair of distinct values. Sums of doubles carry the rounding
    of the running total.

    members: (node_id, cls); cls is the number, null where a node has none (null or NaN: no links).
    """

    members: DataFrame
    gap: float

    @staticmethod
    def above(nodes: DataFrame, column: str, threshold: float, node: str = "node_id") -> "IntervalGraph":
        """Links of X1 on ``column`` above ``threshold``; scale the column first for X3."""
        number = F.col(column).cast("double") + F.lit(0.0)
        members = nodes.select(F.col(node).alias("node_id"), F.when(~F.isnan(number), number).alias("cls"))
        return IntervalGraph(members, _widest_gap(threshold))

    def materialized(self) -> "IntervalGraph":
        return IntervalGraph(materialize(self.members), self.gap)

    def sizes(self) -> DataFrame:
        return self.members.filter("cls is not null").groupBy("cls").agg(F.count(F.lit(1)).alias("m"))

    def _range_totals(self, per_class: DataFrame, columns: list[str], by: list[str], asking: DataFrame) -> DataFrame:
        """For the rows of ``asking`` (cls, by...): sums of ``columns`` over the values within reach, of the same ``by``."""
        if self.gap < 0:
            return asking.limit(0).select("*", *[F.lit(0).cast(per_class.schema[c].dataType).alias(c) for c in columns])
        none = [F.lit(0).cast(per_class.schema[c].dataType).alias(c) for c in columns]
        value = per_class.select(*by, F.col("cls").alias("x"), F.lit(1).alias("kind"), F.col("cls").alias("v"), *columns)
        # At equal x a lower question comes before the value and an upper one behind it.
        ends = F.explode(F.array(
            F.struct((-_reach(-F.col("cls"), self.gap)).alias("x"), F.lit(0).alias("kind")),
            F.struct(_reach(F.col("cls"), self.gap).alias("x"), F.lit(2).alias("kind"))))
        asked = asking.select(*by, F.col("cls").alias("v"), ends.alias("e"), *none).select(*by, "e.x", "e.kind", "v", *columns)
        summed = running_totals(value.unionByName(asked), [*by, "x", "kind"], {f"_u_{c}": F.col(c) for c in columns})
        sign = F.when(F.col("kind") == 2, 1).otherwise(-1)
        return summed.filter("kind <> 1").groupBy(*by, F.col("v").alias("cls")).agg(
            *[F.sum(sign * F.col(f"_u_{c}")).alias(c) for c in columns])

    def class_degrees(self) -> DataFrame:
        sizes = materialize(self.sizes())
        reached = self._range_totals(sizes, ["m"], [], sizes.select("cls"))
        return reached.select("cls", (F.col("m") - 1).alias("deg"), F.lit(True).alias("clique"))

    def linked_totals(self, per_class: DataFrame, columns: list[str]) -> DataFrame:
        known = materialize(per_class.filter("cls is not null").select("cls", *[
            F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]))
        return self._range_totals(known, columns, [], known.select("cls"))

    def label_totals(self, counts: DataFrame) -> DataFrame:
        counts = materialize(counts.withColumnRenamed("y", "y_dst"))
        # Every value asks for every label: as many rows as the result can have per value.
        labels = counts.agg(F.collect_set("y_dst").alias("_all"))
        asking = with_scalars(counts.select("cls").distinct(), labels).select("cls", F.explode("_all").alias("y_dst"))
        return self._range_totals(counts, ["n"], ["y_dst"], asking).filter("n > 0").withColumn("own", F.lit(True))

    def label_mixing(self, counts: DataFrame) -> DataFrame:
        return _label_mixing(self, counts)


def above(similarity: Similarity, threshold: float) -> DataFrame:
    """Pairs with sim > threshold, NaN excluded."""
    if similarity.kind == "dense" and threshold < similarity.min_sim:
        raise ValueError(f"pairs are only complete above {similarity.min_sim}")
    if similarity.kind == "sparse" and threshold < 0:
        raise ValueError("absent pairs are 0; thresholds start there")
    return similarity.pairs.filter(~F.isnan("sim") & (F.col("sim") > threshold))


def build_edges(similarity: Similarity, threshold: float) -> DataFrame:
    """Edge list (src, dst), strictly above the threshold, both directions, no loops."""
    kept = above(similarity, threshold).select("a", "b", "m_a", "m_b")
    if similarity.vectors is not None:
        found = similarity.vectors.node_pairs(threshold).filter(F.col("sim") > threshold)
        return symmetric(found.select("src", "dst"))
    if similarity.found is not None:
        return symmetric(similarity.found().filter(~F.isnan("sim") & (F.col("sim") > threshold)).select("src", "dst"))
    return symmetric(expand_pairs(similarity.members, kept))


def symmetric(pairs: DataFrame) -> DataFrame:
    """Both directions of distinct (src, dst) rows with src < dst."""
    ways = F.array(
        F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")),
    )
    return pairs.select(F.inline(ways))


def undirected(edges: DataFrame) -> DataFrame:
    """U4: union with the reverse direction, duplicates removed."""
    return symmetric(edges.select("src", "dst")).distinct()


# --- pair tables ------------------------------------------------------------


def least_closeness(nodes: DataFrame, column: str) -> float:
    """The smallest X1 similarity of any two nodes: that of the extreme values; 1 without two values."""
    span = nodes.select((F.col(column).cast("double") + F.lit(0.0)).alias("v")).filter("not isnan(v)").agg(F.max("v") - F.min("v")).first()[0]
    return 1.0 if span is None else 1.0 / (1.0 + span)


def normalize_pairs(similarity: Similarity, diagonal: tuple[float, float] = (1.0, 1.0), low: float | None = None) -> Similarity:
    """G1: global min-max over the whole matrix, NaN skipped; unchanged if min = max.

    ``diagonal`` is the range of the self similarities. A sparse matrix also
    holds the 0 of absent pairs. The pairs of a pruned dense one do not show its
    smallest entry: it is then ``low``, for numbers that of :func:`least_closeness`.
    """
    if similarity.kind == "dense" and similarity.min_sim > 0 and low is None:
        raise ValueError("the minimum of a pruned dense similarity is unknown; give it as low")
    lows, highs = [F.min("lo"), F.lit(float(diagonal[0]))], [F.max("hi"), F.lit(float(diagonal[1]))]
    if low is not None:
        lows.append(F.lit(float(low)))
    if similarity.kind == "sparse":
        lows.append(F.lit(0.0))
    span = _extremes(similarity).agg(F.least(*lows).alias("_lo"), F.greatest(*highs).alias("_hi"))

    def scaled(pairs: DataFrame) -> DataFrame:
        wide = F.col("_hi") > F.col("_lo")
        share = F.try_divide(F.col("sim") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
        return with_scalars(pairs, span).withColumn("sim", F.when(wide, share).otherwise(F.col("sim"))).drop("_lo", "_hi")

    known = similarity.vectors is not None or similarity.found is not None
    return replace(similarity, pairs=scaled(similarity.pairs), exact=None, vectors=None,
                   found=(lambda: scaled(similarity.between_nodes())) if known else None)


def _extremes(similarity: Similarity) -> DataFrame:
    """Rows (lo, hi) that together hold the extremes of the pairs; those of vectors leave a block as two numbers."""
    if similarity.vectors is not None:
        inside = similarity.vectors.groups.filter("m > 1").select(F.lit(1.0).alias("lo"), F.lit(1.0).alias("hi"))
        return similarity.vectors.extremes(similarity.min_sim).unionByName(inside)
    known = similarity.pairs.filter(~F.isnan("sim"))
    return known.agg(F.min("sim").alias("lo"), F.max("sim").alias("hi"))


def mixture_configs(
    names: list[str], random: bool = True, n_random: int = 50, alpha: float = 1.0,
    first_no: int = 0, seed: int | None = None,
) -> list[dict]:
    """Weight sets {name: weight, "type": label}: Dirichlet draws, or corners, pairs, centre."""
    if random:
        draws = np.random.default_rng(seed).dirichlet([alpha] * len(names), n_random)
        return [
            {**dict(zip(names, map(float, draw))), "type": f"random_{first_no + i}"}
            for i, draw in enumerate(draws)
        ]

    def shares(chosen, label):
        return {**{n: (1.0 / len(chosen) if n in chosen else 0.0) for n in names}, "type": label}

    corners = [shares([n], f"pure_{n}") for n in names]
    edges = [shares([x, y], f"pair_{x}_{y}") for x, y in combinations(names, 2)]
    return [*corners, *edges, shares(names, "balanced")]


def config_table(spark: SparkSession, configs: list[dict]) -> DataFrame:
    """G2 as rows (config, column, weight)."""
    rows = [(c["type"], name, float(w)) for c in configs for name, w in c.items() if name != "type"]
    return spark.createDataFrame(rows, "config string, column string, weight double")


def combine_pairs(
    similarities: dict[str, Similarity], configs: list[dict], min_sim: float = 0.0
) -> dict[str, Similarity]:
    """Weighted sums of several similarities, one result per configuration.

    Nodes equal in every column form a joint class. Pairs are lifted to joint
    classes and pivoted once, and written, so all configurations read one table.
    With pruned dense inputs the result is complete above ``min_sim`` > 0, see
    :mod:`tabgraph.operators.mixtures`.
    """
    if any(s.kind == "dense" and s.min_sim > 0 for s in similarities.values()):
        return combine_pruned(similarities, configs, min_sim)
    members, lifted = _joint_pairs(similarities)
    lifted = materialize(lifted)
    names = list(similarities)
    kinds = {s.kind for s in similarities.values()}
    kind = "sparse" if kinds == {"sparse"} and min_sim <= 0 else "dense"
    out = {}
    for config in configs:
        total = sum((F.col(f"s_{n}") * F.lit(float(config.get(n, 0.0))) for n in names), F.lit(0.0))
        pairs = lifted.select("a", "b", total.alias("sim"), "m_a", "m_b").filter(F.col("sim") > min_sim)
        out[config["type"]] = Similarity(members, pairs, kind, max(min_sim, 0.0))
    return out


def _joint_pairs(similarities: dict[str, Similarity]) -> tuple[DataFrame, DataFrame]:
    """Joint members, and per pair of joint classes one column s_<name> per similarity."""
    names = list(similarities)
    joined = None
    for name in names:
        own = similarities[name].members.select("node_id", F.col("cls").cast("string").alias(f"c_{name}"))
        joined = own if joined is None else joined.join(own, "node_id")
    keys = [f"c_{n}" for n in names]
    members = joined.withColumn("cls", F.md5(F.to_json(F.struct(*keys))))
    joint = members.groupBy("cls", *keys).agg(F.count(F.lit(1)).alias("m"))
    lifted = None
    for name in names:
        pairs = similarities[name].pairs.select(
            F.col("a").cast("string").alias("_x"), F.col("b").cast("string").alias("_y"), "sim")
        one = joint.select(F.col(f"c_{name}").alias("_x"), F.col("cls").alias("p"), F.col("m").alias("m_p"))
        two = joint.select(F.col(f"c_{name}").alias("_y"), F.col("cls").alias("q"), F.col("m").alias("m_q"))
        met = pairs.join(one, "_x").join(two, "_y")
        # Inside one class of this column each joint pair arises in both orders.
        once = (F.col("_x") != F.col("_y")) | (F.col("p") < F.col("q")) | (
            (F.col("p") == F.col("q")) & (F.col("m_p") > 1))
        swap = F.col("p") > F.col("q")
        rows = met.filter(once).select(
            F.when(swap, F.col("q")).otherwise(F.col("p")).alias("a"),
            F.when(swap, F.col("p")).otherwise(F.col("q")).alias("b"),
            F.when(swap, F.col("m_q")).otherwise(F.col("m_p")).alias("m_a"),
            F.when(swap, F.col("m_p")).otherwise(F.col("m_q")).alias("m_b"),
            *[(F.col("sim") if n == name else F.lit(0.0)).alias(f"s_{n}") for n in names],
        )
        lifted = rows if lifted is None else lifted.unionByName(rows)
    summed = lifted.groupBy("a", "b", "m_a", "m_b").agg(*[F.sum(f"s_{n}").alias(f"s_{n}") for n in names])
    return members.select("node_id", "cls"), summed


# --- thresholds -------------------------------------------------------------


def density_percent(n_nodes: Column, n_edges: Column) -> Column:
    """Undirected edges as a percentage of all node pairs."""
    return F.try_divide(n_edges, n_nodes * (n_nodes - 1) / 2) * 100


def similarity_histogram(similarity: Similarity) -> DataFrame:
    """(slot, n): node pairs per ceil(sim * 2^20), at most 2^20 + 2 rows; NaN counts nowhere."""
    if similarity.vectors is not None:
        return similarity.vectors.histogram(SCALE, similarity.min_sim)
    kept = similarity.weighted().filter(~F.isnan("sim"))
    slot = F.greatest(F.least(F.ceil(F.col("sim") * SCALE), F.lit(SCALE + 1)), F.lit(0))
    slots = kept.select(slot.cast("long").alias("slot"), "weight")
    return slots.groupBy("slot").agg(F.sum("weight").alias("n")).filter("n > 0")


def bisect_threshold(count_above, n_nodes: int, target: float, tolerance: float = 0.1,
                     max_iter: int = 100) -> float:
    """The bisection itself; ``count_above(k)`` is the number of pairs with sim > k / 2^20.

    Stops within tolerance or when the interval falls below 1e-6; returns the
    middle that came closest, 0.0 if none was tried.
    """
    low, high = 0, SCALE
    best, closest = 0, float("inf")
    total = n_nodes * (n_nodes - 1) / 2
    for _ in range(max_iter):
        if (high - low) / SCALE < 1e-6:
            break
        middle = (low + high) // 2
        density = count_above(middle) / total * 100
        if abs(density - target) < closest:
            best, closest = middle, abs(density - target)
        if closest <= tolerance:
            break
        low, high = (middle, high) if density > target else (low, middle)
    return best / SCALE


def threshold_for_density(histogram: DataFrame, n_nodes: int, target: float, tolerance: float = 0.1,
                          max_iter: int = 100, min_sim: float = 0.0) -> float:
    """G6 from a histogram: the pairs are scanned once, not once per step.

    The histogram has at most 2^20 + 2 rows. ``min_sim`` is the pruning of the
    pairs behind it; a search that ends there raises, since lower counts are unknown.
    """
    if n_nodes < 2:
        return 0.0
    rows = histogram.toPandas().sort_values("slot")
    slots, counts = rows["slot"].to_numpy(), rows["n"].to_numpy()
    tail = np.concatenate([counts[::-1].cumsum()[::-1], [0]])

    def count_above(k: int) -> int:
        return int(tail[np.searchsorted(slots, k, side="right")])

    total = n_nodes * (n_nodes - 1) / 2
    floor_k = int(np.ceil(min_sim * SCALE))
    skipped: list[float] = []

    def known_above(k: int) -> float:
        if k >= floor_k:
            return count_above(k)
        # Only a lower bound is known here; it must already exceed the target.
        excess = count_above(floor_k) / total * 100 - target
        if excess <= tolerance:
            raise ValueError(f"pairs above {min_sim} do not reach the target density")
        skipped.append(excess)
        return float("inf")

    found = bisect_threshold(known_above, n_nodes, target, tolerance, max_iter)
    reached = known_above(round(found * SCALE)) / total * 100
    if skipped and not abs(reached - target) <= min(skipped):
        raise ValueError(f"pairs above {min_sim} do not settle the closest threshold")
    return found


def _widest_gap(threshold: float) -> float:
    """Largest distance d with 1 / (1 + d) > threshold in double arithmetic; -1 if none."""
    if threshold <= 0:
        return float("inf")
    if threshold >= 1:
        return -1.0
    gap = 1.0 / threshold - 1.0
    while 1.0 / (1.0 + gap) > threshold:
        gap = float(np.nextafter(gap, np.inf))
    while gap > 0 and not 1.0 / (1.0 + gap) > threshold:
        gap = float(np.nextafter(gap, -np.inf))
    return gap


def _reach(v: Column, gap: float) -> Column:
    """Largest number w with w - v <= gap in double arithmetic, as far as rounding of v + gap blurs it."""
    x = v + F.lit(gap)
    ulp = F.abs(x) * F.lit(1.1 * 2.0**-53)
    half = F.lit(float(np.spacing(gap)) * 0.5 if np.isfinite(gap) else 0.0)
    near = F.array(x, x + ulp, x + ulp * 2, x - ulp, x - ulp * 2, x + half)
    return F.coalesce(F.array_max(F.filter(near, lambda w: w - v <= F.lit(gap))), x)


def pairs_above(values: DataFrame, column: str, thresholds: list[float]) -> list[int]:
    """For 1 / (1 + |difference|): the number of node pairs above each threshold, pairs unseen.

    Every value v asks how many values lie up to v + gap; one distributed running
    total over values and questions answers all of them. n log n for any density.
    """
    return _pairs_above(_value_counts(values, column), thresholds)


def _value_counts(values: DataFrame, column: str) -> DataFrame:
    """(v, m): distinct values and their multiplicities; null and NaN are similar to nothing."""
    number = F.col(column).cast("double") + F.lit(0.0)
    return values.select(number.alias("v")).filter("v is not null and not isnan(v)").groupBy("v").agg(F.count(F.lit(1)).alias("m"))


def _pairs_above(groups: DataFrame, thresholds: list[float]) -> list[int]:
    gaps = [_widest_gap(t) for t in thresholds]
    asked = F.array(*[
        F.struct(F.lit(i).alias("q"), _reach(F.col("v"), g).alias("x")) for i, g in enumerate(gaps)
    ])
    own = groups.select(F.col("v").alias("x"), F.lit(-1).alias("q"), F.col("m").alias("add"), "m")
    questions = groups.select("m", F.explode(asked).alias("a")).select(
        F.col("a.x").alias("x"), F.col("a.q").alias("q"), F.lit(0).cast("long").alias("add"), "m")
    # At equal x values come before questions, so v + gap itself is counted.
    total = running_totals(own.unionByName(questions), ["x", "q"], {"upto": F.col("add")})
    # Ordered pairs (v, w) with w <= v + gap, less those with w < v and self pairs.
    sums = {
        r.q: int(r.s) for r in
        total.groupBy("q").agg(F.sum(product("m", "upto")).alias("s")).collect()
    }
    if not sums:
        return [0] * len(thresholds)
    n = groups.agg(F.sum("m"), F.sum(product("m", "m"))).first()
    below = sums[-1] - int(n[1])  # pairs w < v
    inside = (int(n[1]) - int(n[0])) // 2
    return [
        0 if g < 0 else sums[i] - below - int(n[1]) + inside for i, g in enumerate(gaps)
    ]


def threshold_for_density_numeric(values: DataFrame, column: str, target: float, tolerance: float = 0.1,
                                  levels: int = 5) -> float:
    """G6 for the scalar number similarities, without pairs or a histogram.

    Each pass counts all the middles the next ``levels`` bisection steps could visit.
    """
    groups = materialize(_value_counts(values, column))
    n_nodes = values.count()  # also those without a value
    if n_nodes < 2:
        return 0.0
    known: dict[int, int] = {}

    def look_ahead(k: int) -> None:
        step = k & -k  # distance of a middle to its interval ends
        wanted, spans = [], [(k, step)]
        for _ in range(levels):
            wanted += [m for m, _ in spans]
            spans = [(m + d * (s // 2), s // 2) for m, s in spans for d in (-1, 1) if s >= 2]
        counts = _pairs_above(groups, [m / SCALE for m in wanted])
        known.update(zip(wanted, counts))

    def count_above(k: int) -> int:
        if k not in known:
            look_ahead(k)
        return known[k]

    return bisect_threshold(count_above, n_nodes, target, tolerance)


# --- structure --------------------------------------------------------------


def degree(graph: Graph) -> DataFrame:
    """(node_id, degree), 0 for isolated nodes."""
    degrees = graph.class_degrees().select("cls", "deg")
    return graph.members.join(degrees, "cls", "left").select(
        "node_id", F.coalesce("deg", F.lit(0)).cast("long").alias("degree")
    )


def degree_features(graph: Graph, n_nodes: int, prefix: str = "deg_bin_") -> DataFrame:
    """One-hot log-scale degree bins; bin 0 is degree 0-8, bin 1 is 9-98, ..."""
    size = len(str(n_nodes - 1)) + (1 if n_nodes > 1 else 0)  # as degree_bins
    binned = degree(graph).withColumn("_bin", log_degree_bin(F.col("degree"), F.lit(n_nodes)))
    return binned.withColumns(one_hot(F.col("_bin"), size, prefix)).drop("_bin", "degree")


def data_features(features: DataFrame, columns: list[str], split: str = "split") -> DataFrame:
    """Z-scores of the feature columns, fitted on the train rows."""
    return standard_scale(features, columns, F.col(split) == "train")


def edge_count(graph: Graph) -> DataFrame:
    """One row (n_nodes, n_edges), edges undirected; n_edges is null where it passes 64 bits."""
    return _edge_total(graph).select("n_nodes", F.expr("try_cast(_edges as bigint)").alias("n_edges"))


def _edge_total(graph: "Graph | IntervalGraph") -> DataFrame:
    ends = graph.class_degrees().join(graph.sizes(), "cls")
    edges = ends.agg(F.floor(F.coalesce(F.sum(product("deg", "m")), F.lit(0).cast(PAIRS)) / 2).alias("_edges"))
    nodes = graph.members.agg(F.count(F.lit(1)).alias("n_nodes"))
    return with_scalars(nodes, edges)


def density(graph: Graph) -> DataFrame:
    """One row (n_nodes, n_edges, density)."""
    pairs = F.col("n_nodes").cast("double") * (F.col("n_nodes") - 1) / 2
    return _edge_total(graph).select(
        "n_nodes", F.expr("try_cast(_edges as bigint)").alias("n_edges"),
        (F.try_divide(F.col("_edges").cast("double"), pairs) * 100).alias("density"))


def mixing_counts(graph: Graph, labels: DataFrame, label: str = "y", node: str = "node_id") -> DataFrame:
    """(y_src, y_dst, n): directed edges by the labels of their ends.

    Labels are counted per class first; a pair of classes then adds products of
    counts, so no edge is expanded.
    """
    known = labels.select(F.col(node).alias("node_id"), F.col(label).alias("y"))
    counts = graph.members.join(known, "node_id").groupBy("cls", "y").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.filter("cls is not null")
    return graph.label_mixing(counts).filter("n > 0")


def homophily(mixing: DataFrame) -> DataFrame:
    """One row, the share of edges joining equal labels; NaN without edges."""
    same = F.sum(F.when(F.col("y_src") == F.col("y_dst"), F.col("n")).otherwise(0))
    return mixing.agg((same / F.sum("n")).alias("h")).select(
        F.coalesce("h", F.lit(float("nan"))).alias("homophily_ratio")
    )


def assortativity(mixing: DataFrame) -> DataFrame:
    """One row, Newman's coefficient over both edge directions; works on C x C rows."""
    ways = mixing.select(F.inline(F.array(
        F.struct(F.col("y_src").alias("i"), F.col("y_dst").alias("j"), F.col("n").alias("n")),
        F.struct(F.col("y_dst").alias("i"), F.col("y_src").alias("j"), F.col("n").alias("n")),
    ))).groupBy("i", "j").agg(F.sum("n").cast("double").alias("n"))
    total = ways.agg(F.sum("n").alias("_t"))
    e = with_scalars(ways, total).withColumn("e", F.col("n") / F.col("_t"))
    rows = e.groupBy("i").agg(F.sum("e").alias("a"), F.sum(F.when(F.col("i") == F.col("j"), F.col("e")).otherwise(0.0)).alias("d"))
    cols = e.groupBy(F.col("j").alias("i")).agg(F.sum("e").alias("b"))
    sums = rows.join(cols, "i").agg(F.sum("d").alias("d"), F.sum(F.col("a") * F.col("b")).alias("x"))
    return sums.select(((F.col("d") - F.col("x")) / (1 - F.col("x") + 1e-12)).alias("assortativity"))


def graph_summary(graph: Graph, labels: DataFrame, label: str = "y", node: str = "node_id",
                  **tags) -> DataFrame:
    """One row: size, density, assortativity, homophily, and constant tags."""
    graph = graph.materialized()
    mixing = materialize(mixing_counts(graph, labels, label, node))
    row = with_scalars(with_scalars(density(graph), assortativity(mixing)), homophily(mixing))
    return row.withColumns({k: F.lit(v) for k, v in tags.items()}) if tags else row


# --- neighbours -------------------------------------------------------------


def top_n_similar_all(similarity: Similarity, n: int) -> DataFrame:
    """(node_id, rank, neighbour, similarity): the ``n`` most similar other nodes of each.

    Ties go to the smaller id. A class can fill at most n + 1 places, so its
    n + 1 smallest ids stand for it; each class ranks at most n + 1 classes. A node
    finishes its list in its own row, from the list of its class.

    Sparse families are complete: nodes at similarity 0 fill the list, and the smallest n + 1
    ids of all hold enough of them. A dense family ends at its ``min_sim``; for one number
    :func:`top_n_closest` is complete.
    """
    wanted = n + 1
    by_id = Window.partitionBy("cls").orderBy("node_id")
    firsts = similarity.members.withColumn("_no", F.row_number().over(by_id)).filter(F.col("_no") <= wanted)
    heads = firsts.filter("_no = 1").select(F.col("cls").alias("b"), F.col("node_id").alias("_head"))
    links = _directed(similarity).join(heads, "b")
    best = Window.partitionBy("a").orderBy(F.desc("sim"), "_head")
    links = links.withColumn("_no", F.row_number().over(best)).filter(F.col("_no") <= wanted)
    options = links.select("a", "b", "sim").join(
        firsts.select(F.col("cls").alias("b"), F.col("node_id").alias("neighbour")), "b")
    near = Window.partitionBy("a").orderBy(F.desc("sim"), "neighbour")
    options = options.withColumn("_no", F.row_number().over(near)).filter(F.col("_no") <= wanted)
    place = F.struct((F.lit(0.0) - F.col("sim")).alias("far"), "neighbour")
    lists = options.groupBy(F.col("a").alias("cls")).agg(F.collect_list(place).alias("_near"))
    # A node has one class, save where its id repeats; only then are lists gathered by node.
    own = similarity.members.filter("node_id is not null")
    counted = own.groupBy("node_id").agg(F.count(F.lit(1)).alias("_rows"), F.min("cls").alias("cls"))
    single = counted.filter("_rows = 1").join(lists, "cls", "left").select("node_id", "_near")
    several = own.join(counted.filter("_rows > 1").select("node_id"), "node_id").join(lists, "cls", "left").groupBy(
        "node_id").agg(F.flatten(F.collect_list("_near")).alias("_near"))
    near = F.coalesce("_near", F.array().cast(lists.schema["_near"].dataType))
    mine = single.unionByName(several).withColumn("_near", near)
    if similarity.kind == "sparse":
        smallest = similarity.members.orderBy("node_id").limit(n + 1)
        packed = smallest.agg(F.transform(F.sort_array(F.collect_list("node_id")), lambda i: F.struct(
            F.lit(0.0).alias("far"), i.alias("neighbour"))).alias("_fill"))
        mine = with_scalars(mine, packed).select("node_id", F.concat("_near", "_fill").alias("_near"))
    ranked = F.array_sort(F.filter("_near", lambda p: p["neighbour"] != F.col("node_id")))
    if similarity.kind == "sparse":  # each neighbour once, where it is nearest
        ranked = bound(ranked, lambda all_: F.filter(all_, lambda p, i: F.array_position(
            F.transform(all_, lambda q: q["neighbour"]), p["neighbour"]) == i + 1))
    return mine.select("node_id", F.posexplode(F.slice(ranked, 1, n)).alias("_at", "_p")).select(
        "node_id", (F.col("_at") + 1).alias("rank"), F.col("_p.neighbour").alias("neighbour"),
        (F.lit(0.0) - F.col("_p.far")).alias("similarity"))


def top_n_closest(nodes: DataFrame, column: str, n: int, node: str = "node_id") -> DataFrame:
    """W5 for one number, complete: min(n, N - 1) rows for every node with a value.

    A value's nearest nodes lie among the n + 1 distinct values on either side of it, and a
    value fills at most n + 1 places with its smallest ids, so distinct values meet by dense
    rank and nothing is compared with everything.
    """
    number = F.col(column).cast("double") + F.lit(0.0)
    members = nodes.select(F.col(node).alias("node_id"), number.alias("v")).filter(~F.isnan("v"))
    by_id = Window.partitionBy("v").orderBy("node_id")
    firsts = members.withColumn("_no", F.row_number().over(by_id)).filter(F.col("_no") <= n + 1)
    ranked = materialize(ordered_index(members.select("v").distinct(), ["v"], "_rank"))
    meets = F.explode(F.sequence(F.col("_rank") - (n + 1), F.col("_rank") + (n + 1)))
    other = ranked.join(firsts, "v").select("_rank", F.col("v").alias("w"), F.col("node_id").alias("neighbour"))
    options = ranked.select(F.col("v").alias("a"), meets.alias("_rank")).join(other, "_rank").withColumn(
        "similarity", closeness(F.col("a"), F.col("w")))
    near = Window.partitionBy("a").orderBy(F.desc("similarity"), "neighbour")
    options = options.withColumn("_no", F.row_number().over(near)).filter(F.col("_no") <= n + 1)
    mine = members.withColumnRenamed("v", "a").join(options.select("a", "neighbour", "similarity"), "a")
    final = Window.partitionBy("node_id").orderBy(F.desc("similarity"), "neighbour")
    return mine.filter("node_id <> neighbour").withColumn("rank", F.row_number().over(final)).filter(
        F.col("rank") <= n).select("node_id", "rank", "neighbour", "similarity")


def top_n_by_vector(
    nodes: DataFrame, vec_col: str, query_node: int, feature: Column, n: int = 10,
    label: str | None = None, node: str = "node_id",
) -> DataFrame:
    """W4 for vectors, in one scan: (node_index, similarity, feature[, label]) by cosine with one node's vector."""
    unit = l2_normalize(F.transform(vec_col, lambda x: x.cast("double")))
    asked = nodes.filter(F.col(node) == query_node).limit(1).select(unit.alias("_q"))
    dot = F.aggregate(F.zip_with(unit, F.col("_q"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    extra = [feature.alias("feature")] + ([F.col(label).alias("label")] if label else [])
    named = nodes.withColumn("node_id", F.col(node)).filter(F.col("node_id") != query_node)
    scored = with_scalars(named.filter(F.col(vec_col).isNotNull()), asked)
    return scored.select(F.col("node_id").alias("node_index"), dot.alias("similarity"), *extra).orderBy(
        F.desc("similarity"), "node_index").limit(n).withColumnsRenamed({"label": label} if label else {})


def _directed(similarity: Similarity) -> DataFrame:
    kept = similarity.pairs.filter(~F.isnan("sim")).select("a", "b", "sim")
    ways = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(F.array(
        F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return kept.select(F.explode(ways).alias("p"), "sim").select("p.a", "p.b", "sim")


def top_n_similar(
    similarity: Similarity, query_node: int, nodes: DataFrame, feature: Column, n: int = 10,
    label: str | None = None, node: str = "node_id",
) -> DataFrame:
    """(node_index, similarity, feature[, label]) of the ``n`` nodes most similar to one node."""
    own = similarity.members.filter(F.col("node_id") == query_node).select(F.col("cls").alias("a"))
    near = _directed(similarity).join(F.broadcast(own), "a").select(F.col("b").alias("cls"), "sim")
    scored = similarity.members.join(near, "cls").filter(F.col("node_id") != query_node)
    best = scored.orderBy(F.desc("sim"), "node_id").limit(n)
    extra = [feature.alias("feature")] + ([F.col(label).alias("label")] if label else [])
    shown = nodes.select(F.col(node).alias("node_id"), *extra)
    return best.join(shown, "node_id").select(
        F.col("node_id").alias("node_index"), F.col("sim").alias("similarity"), "feature",
        *(["label"] if label else []),
    )
