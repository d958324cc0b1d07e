"""Similarity between all nodes, in factored form.

Nodes with the same value form a class. A :class:`Similarity` holds who belongs
to which class and one row per *pair of classes*; the similarity inside a class
is the row ``a = b``. A value shared by a third of all nodes is then one row,
not m*m/2 of them, and every consumer (density, degree, homophily, propagation,
top-n, mixtures) works on classes. Node pairs appear only when an edge list is
asked for.

Pair joins are candidate joins on slots, cells or rare items that provably lose
no pair above ``min_sim``; there is no cross join.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabgraph.distributed import hot_keys, materialize, split_hot
from tabgraph.functions.numbers import bound, l2_normalize, minmax_scale, stable_key

#: Widening of candidate radii, so that rounding never loses a borderline pair.
_SLACK = 1 + 1e-9


@dataclass(frozen=True)
class Exact:
    """Random access to a similarity: ``of`` applied to the values of two classes.

    values: (cls, value), a row per class. A class without a row is similar to nothing.
    """

    values: DataFrame
    of: Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Similarity:
    """Factored similarity of one column.

    members: (node_id, cls). pairs: (a, b, sim, m_a, m_b) with a <= b and m the
    class sizes; a = b only for classes of two or more. kind "sparse": absent
    pairs are exactly 0. kind "dense": an absent pair is at most ``min_sim``;
    ``exact`` then tells the similarity of any two classes. ``vectors`` answers
    from products of blocks what would otherwise read the pairs. ``found`` writes
    the node pairs where they are found, so that no pair is shuffled.
    """

    members: DataFrame
    pairs: DataFrame
    kind: str
    min_sim: float = 0.0
    exact: Exact | None = None
    vectors: "Vectors | None" = None
    found: Callable[[], DataFrame] | None = None

    def with_pairs(self, pairs: DataFrame) -> "Similarity":
        return replace(self, pairs=pairs, vectors=None, found=None)

    def weighted(self) -> DataFrame:
        """Pairs with ``weight``, the number of node pairs each stands for."""
        return self.pairs.withColumn("weight", pair_weight())

    def between_nodes(self) -> DataFrame:
        """(src, dst, sim), src < dst: every node pair. For small results and exports."""
        if self.vectors is not None:
            return self.vectors.node_pairs(self.min_sim)
        if self.found is not None:
            return self.found()
        return expand_pairs(self.members, self.pairs)


def pair_weight() -> Column:
    m = F.col("m_a")
    # The even factor is halved first, so the product itself has to fit, not its double.
    inside = F.when(m % 2 == 0, F.shiftright(m, 1) * (m - 1)).otherwise(m * F.shiftright(m - 1, 1))
    return F.when(F.col("a") == F.col("b"), inside).otherwise(m * F.col("m_b"))


def expand_pairs(members: DataFrame, pairs: DataFrame, rows_per_part: int = 20_000) -> DataFrame:
    """Class pairs to node pairs (src < dst), keeping the other pair columns.

    Big classes are dealt over parts, and a pair of them over part pairs, so no
    task expands more than ``rows_per_part`` squared rows of one pair at a time.
    """
    hot = hot_keys(members, ["cls"], rows_per_part)
    parts = hot.select("cls", F.ceil(F.col("n") / rows_per_part).alias("_parts"))
    dealt = split_hot(members.select("node_id", "cls"), ["cls"], ["node_id"], rows_per_part)
    extra = [c for c in pairs.columns if c not in ("a", "b", "m_a", "m_b")]

    def lanes(side: str) -> DataFrame:
        return parts.select(F.col("cls").alias(side), F.col("_parts").alias(f"_n_{side}"))

    spread = pairs.select("a", "b", *extra).join(lanes("a"), "a", "left").join(lanes("b"), "b", "left")
    for side in "ab":
        last = F.coalesce(F.col(f"_n_{side}"), F.lit(1)) - 1
        spread = spread.withColumn(f"_p_{side}", F.explode(F.sequence(F.lit(0), last)))
    one = dealt.select(F.col("cls").alias("a"), F.col("part").alias("_p_a"), F.col("node_id").alias("_i"))
    two = dealt.select(F.col("cls").alias("b"), F.col("part").alias("_p_b"), F.col("node_id").alias("_j"))
    both = spread.join(one, ["a", "_p_a"]).join(two, ["b", "_p_b"])
    return both.filter((F.col("a") != F.col("b")) | (F.col("_i") < F.col("_j"))).select(
        F.least("_i", "_j").alias("src"), F.greatest("_i", "_j").alias("dst"), *extra
    )


def _classes(members: DataFrame, *payload: str) -> DataFrame:
    """(cls, m, payload...): class sizes, counted map-side first."""
    firsts = [F.first(c).alias(c) for c in payload]
    return members.groupBy("cls").agg(F.count(F.lit(1)).alias("m"), *firsts)


def _sides(left: DataFrame, right: DataFrame, payload: list[str]):
    """Column renames for joining a class table to itself."""
    one = {"cls": "a", "m": "m_a", **{c: f"{c}_a" for c in payload}}
    two = {"cls": "b", "m": "m_b", **{c: f"{c}_b" for c in payload}}
    return left.withColumnsRenamed(one), right.withColumnsRenamed(two)


def _inside(groups: DataFrame, sim: Column) -> DataFrame:
    """The a = b rows of classes with at least two members."""
    return groups.filter("m > 1").select(
        F.col("cls").alias("a"), F.col("cls").alias("b"), sim.alias("sim"),
        F.col("m").alias("m_a"), F.col("m").alias("m_b"),
    )


def _ordered(pairs: DataFrame) -> DataFrame:
    """Swap sides where needed so that a <= b."""
    swap = F.col("a") > F.col("b")
    return pairs.select(
        F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"),
        F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"),
        "sim",
        F.when(swap, F.col("m_b")).otherwise(F.col("m_a")).alias("m_a"),
        F.when(swap, F.col("m_a")).otherwise(F.col("m_b")).alias("m_b"),
    )


# --- numbers ----------------------------------------------------------------


def closeness(x: Column, y: Column) -> Column:
    """1 / (1 + |x - y|)."""
    return F.lit(1.0) / (F.lit(1.0) + F.abs(x - y))


def radius_above(min_sim: float) -> float:
    """Distance below which closeness exceeds ``min_sim``."""
    if min_sim <= 0:
        raise ValueError("a pair table of a dense similarity needs min_sim > 0; "
                         "for thresholds and densities use pairs_above or a histogram")
    return (1.0 / min_sim - 1.0) * _SLACK


def _band_join(groups: DataFrame, value: str, radius: float, payload: list[str], spread: bool = False) -> DataFrame:
    """Pairs of classes whose values lie within ``radius``, each once, by slots of that width.

    ``spread`` keeps the session's shuffle partitions, where rows become many more behind the join.
    """
    slot = F.floor(F.col(value) / F.lit(max(radius, 1e-300)))
    left, right = _sides(
        groups.withColumn("_slot", slot),
        groups.withColumn("_slot", F.explode(F.array(slot, slot - 1))),
        [value, *payload],
    )
    if spread:
        n = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        left, right = left.repartition(n, "_slot"), right.repartition(n, "_slot")
    x, y = F.col(f"{value}_a"), F.col(f"{value}_b")
    ahead = (x < y) | ((x == y) & (F.col("a") < F.col("b")))
    return left.join(right, "_slot").filter(ahead & (y - x <= radius))


def sim_count(nodes: DataFrame, column: str, min_sim: float, node: str = "node_id") -> Similarity:
    """1 / (1 + |difference|); classes are the distinct values.

    A null or NaN is similar to nothing: its node stays a member, without a class.
    """
    number = F.col(column).cast("double") + F.lit(0.0)
    members = nodes.select(F.col(node).alias("node_id"), F.when(~F.isnan(number), number).alias("cls"))
    groups = _classes(members.filter("cls is not null")).withColumn("v", F.col("cls"))
    near = _band_join(groups, "v", radius_above(min_sim), [])
    near = near.withColumn("sim", closeness(F.col("v_a"), F.col("v_b"))).filter(F.col("sim") > min_sim)
    columns = ["a", "b", "sim", "m_a", "m_b"]
    inside = _inside(groups, F.lit(1.0))
    pairs = near.select(*columns).unionByName(inside)
    exact = Exact(groups.select("cls", F.col("v").alias("value")), closeness)
    return Similarity(members, pairs, "dense", min_sim, exact, found=lambda: expand_pairs(members, inside).unionByName(
        _number_pairs(members, min_sim)))


def _number_pairs(members: DataFrame, min_sim: float) -> DataFrame:
    """(src, dst, sim) of node pairs with different numbers above ``min_sim``, written where they are found.

    Parts of classes meet with the ids of their members, so a pair is never shuffled.
    """
    parts = _parts(members, _PART).select("cls", F.col("cls").alias("v"), F.lit(1).alias("m"), "ids")
    near = _band_join(parts, "v", radius_above(min_sim), ["ids"], spread=True)
    near = near.withColumn("sim", closeness(F.col("v_a"), F.col("v_b"))).filter(F.col("sim") > min_sim)
    return _of_lists(near)


def _of_lists(pairs: DataFrame) -> DataFrame:
    """(src, dst, sim), src < dst, of pairs (ids_a, ids_b, sim) of lists of (node_id)."""
    one = pairs.select(F.explode("ids_a").alias("_one"), "ids_b", "sim").select(F.col("_one.node_id").alias("_i"), "ids_b", "sim")
    both = one.select("_i", F.explode("ids_b").alias("_two"), "sim").select("_i", F.col("_two.node_id").alias("_j"), "sim")
    return both.select(F.least("_i", "_j").alias("src"), F.greatest("_i", "_j").alias("dst"), "sim")


def sim_count_checked(
    nodes: DataFrame, features: DataFrame, min_sim: float, column: str = "num_reviews",
    node: str = "node_id", key: str = "customer_id",
) -> Similarity:
    """X1 on a column of a feature table, after checking that its rows align with the nodes."""
    from tabgraph.operators.rows import assert_aligned, require_columns

    require_columns(features, [node, column])
    assert_aligned(nodes, features, node, key)
    return sim_count(features, column, min_sim, node)


def sim_numeric(nodes: DataFrame, column: str, min_sim: float, node: str = "node_id") -> Similarity:
    """X1 on min-max scaled values."""
    scaled = minmax_scale(nodes.select(node, column), column, "_scaled")
    return sim_count(scaled, "_scaled", min_sim, node)


def wasserstein(a: Column, b: Column) -> Column:
    """Earth mover's distance of two bags of numbers, the area between their CDFs."""
    def counted(bag):
        return F.transform(bag, lambda x: F.struct(x.cast("double").alias("x"), F.lit(1.0).alias("n")))

    return _cdf_area(counted(a), counted(b))


def _cdf_area(a: Column, b: Column) -> Column:
    """X4 on bags given as entries (x, n)."""
    def total(bag):
        return F.aggregate(bag, F.lit(0.0), lambda acc, e: acc + e["n"])

    def steps(bag, sign):
        held = F.struct(bag.alias("bag"), total(bag).alias("total"))
        return bound(held, lambda h: F.transform(h["bag"], lambda e: F.struct(
            e["x"].alias("x"), F.try_divide(e["n"] * F.lit(sign), h["total"]).alias("w"))))

    start = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("gap"), F.lit(0.0).alias("area"))

    def sweep(state, step):
        return F.struct(
            step["x"].alias("x"), (state["gap"] + step["w"]).alias("gap"),
            (state["area"] + F.abs(state["gap"]) * (step["x"] - state["x"])).alias("area"),
        )

    merged = F.array_sort(F.concat(steps(a, 1.0), steps(b, -1.0)))
    return F.aggregate(merged, start, sweep, lambda s: s["area"])


def _bags(nodes: DataFrame, items: DataFrame, item_type: str, node: str) -> DataFrame:
    """(node_id, entries, cls): each node's distinct items with their counts, and its class key.

    Rows combine map-side per (node, item) before they meet, so a cell grows
    with the distinct items of a node, not with its rows.
    """
    counted = items.select(F.col(node).alias("node_id"), F.col("item").cast(item_type).alias("x")).filter(
        F.col("x").isNotNull()).groupBy("node_id", "x").agg(F.count(F.lit(1)).alias("n"))
    cells = counted.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("x", "n"))).alias("entries"))
    empty = F.array().cast(f"array<struct<x:{item_type},n:bigint>>")
    return nodes.select(F.col(node).alias("node_id")).join(cells, "node_id", "left").select(
        "node_id", F.coalesce("entries", empty).alias("entries")
    ).withColumn("cls", F.md5(F.to_json("entries")))


#: Bags per block: every bag is sent to as many tasks as there are blocks near its mean.
BAG_BLOCK = 4096
#: Cells of the lower bounds, and how many of them make a coarse one.
_CELLS, _COARSE = 64, 8
#: Bags of a block compared at a time, and pairs or entries of pairs measured at a time.
_BAG_TILE, _AT_ONCE = 128, 500_000
#: Members of a bag that travel with it where node pairs are written.
_BAG_PART = 1024


def _emit_distributions(min_sim: float, nodes: bool = False):
    """Pairs of joined blocks of bags with similarity above ``min_sim``: of classes, or of lists of their ``nodes``.

    The distance is the area between two CDFs. In any cell it is at least the difference of the areas under
    them, so the sum of these over disjoint cells bounds it from below: first over coarse cells for all pairs
    whose means are near, then over fine ones for what is left. Only the rest is measured.
    """
    radius = radius_above(min_sim)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            col = {name: batch.column(name) for name in batch.schema.names}
            for r in range(batch.num_rows):
                a, b = (_BagBlock(col, r, side) for side in "ab")
                low, high = min(a.x.min(), b.x.min()), max(a.x.max(), b.x.max())
                edges = np.quantile(np.concatenate([a.x, b.x]), np.linspace(0, 1, _CELLS + 1))
                edges[0], edges[-1] = low, high
                reach = radius + 1e-12 * (high - low)
                for bags in (a, b):
                    bags.place(edges)
                if nodes:
                    lists = [col[f"ids_{side}"][r].values.take(pa.array(bags.order)) for side, bags in (("a", a), ("b", b))]
                home = col["home_b"][r].values.to_numpy(zero_copy_only=False).astype(bool)[b.order]
                number = np.unique(np.concatenate([a.ids, b.ids]), return_inverse=True)[1]
                no_a, no_b = number[:len(a.ids)], number[len(a.ids):]
                for start in range(0, len(a.ids), _BAG_TILE):
                    at = slice(start, min(start + _BAG_TILE, len(a.ids)))
                    first = np.searchsorted(b.mean, a.mean[start] - reach)
                    last = np.searchsorted(b.mean, a.mean[at.stop - 1] + reach, side="right")
                    near = np.zeros((at.stop - start, last - first))
                    for one, two in zip(a.coarse[:, at], b.coarse[:, first:last]):
                        near += np.abs(one[:, None] - two)
                    x, y = np.nonzero((near <= reach) & (~home[first:last] | (no_a[at, None] < no_b[first:last])))
                    x, y = x + start, y + first
                    for cut in range(0, len(x), _AT_ONCE):
                        i, j = x[cut:cut + _AT_ONCE], y[cut:cut + _AT_ONCE]
                        bound = np.zeros(len(i))
                        for one, two in zip(a.fine, b.fine):
                            bound += np.abs(one.take(i) - two.take(j))
                        kept = bound <= reach
                        for i, j, distance in _distances(a, b, i[kept], j[kept]):
                            sim = 1.0 / (1.0 + distance)
                            hit = sim > min_sim
                            i, j = i[hit], j[hit]
                            if nodes:
                                yield from _list_rows(lists[0], lists[1], i, j, sim[hit])
                                continue
                            yield pa.RecordBatch.from_pydict({
                                "a": pa.array(a.ids[i], pa.string()), "b": pa.array(b.ids[j], pa.string()),
                                "sim": pa.array(sim[hit], pa.float64()),
                                "m_a": pa.array(a.m[i], pa.int64()), "m_b": pa.array(b.m[j], pa.int64()),
                            })

    return run


def _list_rows(one, two, x, y, sim, ids: int = 200_000):
    """Batches (ids_a, ids_b, sim) of pairs (x, y) of lists, of about so many ids."""
    import numpy as np
    import pyarrow as pa

    size = [np.diff(side.offsets.to_numpy()) for side in (one, two)]
    ends = np.cumsum(size[0][x] + size[1][y])
    cut = 0
    while cut < len(x):
        to = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + ids, side="right")))
        yield pa.RecordBatch.from_arrays(
            [one.take(pa.array(x[cut:to])), two.take(pa.array(y[cut:to])), pa.array(sim[cut:to])], ["ids_a", "ids_b", "sim"])
        cut = to


class _BagBlock:
    """Bags of one side of a block row: all entries (x, share) one after the other, and the bags by mean."""

    def __init__(self, col, r: int, side: str):
        import numpy as np

        part = lambda name: col[f"{name}_{side}"][r].values
        self.ids, self.m = (part(c).to_numpy(zero_copy_only=False) for c in ("cls", "m"))
        x, n = part("entries").flatten()
        self.x, n = x.to_numpy(zero_copy_only=False), n.to_numpy(zero_copy_only=False).astype(float)
        self.size = part("size").to_numpy(zero_copy_only=False).astype(np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.share = n / np.repeat(np.add.reduceat(n, self.start), self.size)

    def place(self, edges) -> None:
        """Sorts the bags by mean and finds the areas under their CDFs between ``edges``."""
        import numpy as np

        mean = np.add.reduceat(self.share * (self.x - edges[0]), self.start) + edges[0]
        self.order = np.argsort(mean, kind="stable")
        areas = [np.add.reduceat(self.share * np.clip(high - self.x, 0.0, high - low), self.start)[self.order]
                 for low, high in zip(edges, edges[1:])]
        self.fine = np.stack(areas)
        self.coarse = self.fine.reshape(-1, _COARSE, len(mean)).sum(axis=1)
        self.mean = mean[self.order]
        self.ids, self.m, self.size, self.start = (v[self.order] for v in (self.ids, self.m, self.size, self.start))

    def padded(self, bags, sign: float):
        """(x, signed share) of some bags as rectangles: behind its last entry a bag repeats it with no share."""
        import numpy as np

        size = self.size[bags][:, None]
        place = np.arange(size.max())
        at = self.start[bags][:, None] + np.minimum(place, size - 1)
        return self.x[at], np.where(place < size, sign * self.share[at], 0.0)


def _distances(a: _BagBlock, b: _BagBlock, i, j):
    """(i, j, X4) of pairs of bags, in parts of like size; sums run as in :func:`_cdf_area`."""
    import numpy as np

    size = a.size[i] + b.size[j]
    order = np.argsort(size, kind="stable")
    i, j, size = i[order], j[order], size[order]
    cut = 0
    while cut < len(i):
        to = min(cut + max(1, _AT_ONCE // int(size[cut])), len(i))
        to = max(cut + 1, min(to, cut + _AT_ONCE // int(size[to - 1])))
        (x, w), (u, v) = b.padded(j[cut:to], -1.0), a.padded(i[cut:to], 1.0)
        x, w = np.concatenate([x, u], axis=1), np.concatenate([w, v], axis=1)
        by_x = np.argsort(x, axis=1, kind="stable")
        x, w = np.take_along_axis(x, by_x, axis=1), np.take_along_axis(w, by_x, axis=1)
        steps = np.abs(np.cumsum(w, axis=1)[:, :-1]) * np.diff(x, axis=1)
        yield i[cut:to], j[cut:to], np.cumsum(steps, axis=1)[:, -1]
        cut = to


def _exploded(nodes: DataFrame, list_col: str, node: str) -> DataFrame:
    return nodes.select(node, F.explode(list_col).alias("item"))


def sim_distribution(nodes: DataFrame, list_col: str, min_sim: float, node: str = "node_id") -> Similarity:
    """X5 on list cells, see :func:`sim_distribution_items`."""
    return sim_distribution_items(nodes, _exploded(nodes, list_col, node), min_sim, node)


def sim_distribution_items(
    nodes: DataFrame, items: DataFrame, min_sim: float, node: str = "node_id", block: int = BAG_BLOCK
) -> Similarity:
    """1 / (1 + X4) between the bags of numbers in ``items`` (node, item).

    Two empty bags 1, one empty 0; nulls and NaN dropped first. Bags further
    apart in mean than the allowed distance cannot be similar
    (Kantorovich-Rubinstein), so blocks of bags meet where their means do. There
    the areas under both CDFs, cell by cell, bound the distance from below and
    leave few pairs to be measured, see :func:`_emit_distributions`.
    """
    clean = items.filter(~F.isnan(F.col("item").cast("double")))
    members = _bags(nodes, clean, "double", node)
    groups = materialize(_classes(members, "entries"))

    def total(of):
        return F.aggregate("entries", F.lit(0.0), lambda acc, e: acc + of(e))

    mean = F.try_divide(total(lambda e: e["x"] * e["n"]), total(lambda e: e["n"]))
    filled = groups.filter(F.size("entries") > 0).withColumns({"mean": mean, "size": F.size("entries")})
    filled = filled.filter(F.abs("mean") < float("inf"))
    slot = F.floor(F.col("mean") / F.lit(max(radius_above(min_sim), 1e-300)))
    roles = F.array(*[F.struct(at.cast("string").alias("cell"), F.lit(role).alias("role"), F.lit(home).alias("home"))
                      for at, role, home in ((slot, 0, True), (slot, 1, True), (slot - 1, 1, False))])
    met = _meeting_blocks(filled, roles, ["cls", "m", "size"], "entries", block, halved=False)
    near = met.mapInArrow(_emit_distributions(min_sim), "a string, b string, sim double, m_a long, m_b long")
    inside = _inside(groups, F.lit(1.0))
    pairs = _ordered(near).unionByName(inside)
    kind = members.schema["node_id"].dataType.simpleString()

    def found() -> DataFrame:
        held = materialize(members.select("node_id", "cls"))
        # Parts of a class repeat its bag, and are measured again: few for classes of usual size.
        dealt = filled.join(_parts(held, _BAG_PART), "cls")
        blocks = _meeting_blocks(dealt, roles, ["cls", "m", "size", "ids"], "entries", block, halved=False)
        ids = f"array<struct<node_id: {kind}>>"
        near = blocks.mapInArrow(_emit_distributions(min_sim, True), f"ids_a {ids}, ids_b {ids}, sim double")
        return expand_pairs(held, inside).unionByName(_of_lists(near))

    def of(a: Column, b: Column) -> Column:
        empty = (F.size(a) == 0).cast("int") + (F.size(b) == 0).cast("int")
        return F.when(empty == 2, 1.0).when(empty == 1, 0.0).otherwise(F.lit(1.0) / (F.lit(1.0) + _cdf_area(a, b)))

    exact = Exact(groups.select("cls", F.col("entries").alias("value")), of)
    return Similarity(members.select("node_id", "cls"), pairs, "dense", min_sim, exact, found=found)


# --- categories -------------------------------------------------------------


def sim_exact(nodes: DataFrame, column: str, node: str = "node_id") -> Similarity:
    """1 for equal values, missing equal to missing only. One row per value."""
    members = nodes.select(
        F.col(node).alias("node_id"), stable_key(F.col(column), nodes.schema[column].dataType).alias("cls")
    )
    return Similarity(members, _inside(_classes(members), F.lit(1.0)), "sparse")


def sim_grouped(nodes: DataFrame, column: str, related: DataFrame, node: str = "node_id") -> Similarity:
    """1 if the expansions {v} + related(v) overlap, also through a third value.

    ``related`` has columns (key, related). Works on distinct values only.
    """
    members = sim_exact(nodes, column, node).members
    groups = _classes(members)
    known = related.select(
        F.concat(F.lit("="), F.col("key").cast("string")).alias("cls"),
        F.concat(F.lit("="), F.col("related").cast("string")).alias("token"),
    )
    tokens = groups.select("cls", "m", F.col("cls").alias("token")).unionByName(
        groups.join(known, "cls").select("cls", "m", "token")
    ).distinct()
    left, right = _sides(tokens, tokens, [])
    met = left.join(right, "token").filter("a < b").select("a", "b", F.lit(1.0).alias("sim"), "m_a", "m_b")
    return Similarity(members, met.distinct().unionByName(_inside(groups, F.lit(1.0))), "sparse")


def _hit_share(own: Column, other: Column) -> Column:
    """Share of a bag (entries item, w, related) whose related items meet another bag's items."""
    weight = lambda bag: F.aggregate(bag, F.lit(0.0), lambda acc, e: acc + e["w"])
    held = F.struct(own.alias("own"), F.transform(other, lambda e: e["item"]).alias("items"))
    met = bound(held, lambda h: F.filter(h["own"], lambda e: F.arrays_overlap(e["related"], h["items"])))
    return F.try_divide(weight(met), weight(own))


def sim_overlap(
    nodes: DataFrame, list_col: str, related: DataFrame | None = None, min_sim: float = 0.0,
    node: str = "node_id",
) -> Similarity:
    """X11 on list cells, see :func:`sim_overlap_items`."""
    return sim_overlap_items(nodes, _exploded(nodes, list_col, node), related, min_sim, node)


def sim_overlap_items(
    nodes: DataFrame, items: DataFrame, related: DataFrame | None = None, min_sim: float = 0.0,
    node: str = "node_id",
) -> Similarity:
    """X11: mean of the two shares of a bag, by multiplicity, that meet the other bag.

    ``items`` has (node, item). An item meets a bag through any of its related
    items (itself if it has none). Empty bags have similarity 0 to all. For
    ``min_sim`` > 0 one of the two shares must exceed it, so only a bag's rarest
    items look for candidates, see :func:`_overlap_candidates`.
    """
    members = _bags(nodes, items, "string", node)
    groups = materialize(members.groupBy("cls").agg(
        F.count(F.lit(1)).alias("m"), F.first("entries").alias("bag"), F.min("node_id").alias("id")
    ).filter(F.size("bag") > 0))

    # A class travels as its smallest node id; it gets its key back at the end.
    total = F.aggregate("bag", F.lit(0.0), lambda acc, e: acc + e["n"])
    items = groups.select("id", total.alias("total"), F.explode("bag").alias("e")).select(
        "id", "total", F.col("e.x").alias("item"), F.col("e.n").cast("double").alias("w"))
    if related is None:
        bags = groups.select("id", "cls", "m", F.transform("bag", lambda e: F.struct(
            e["x"].alias("item"), e["n"].cast("double").alias("w"), F.array(e["x"]).alias("related"))).alias("entries"))
    else:
        expansions = related.groupBy(F.col("key").cast("string").alias("item")).agg(
            F.array_sort(F.collect_set(F.col("related").cast("string"))).alias("related")
        )
        items = items.join(expansions, "item", "left").withColumn(
            "related", F.coalesce("related", F.array("item"))
        )
        entry = F.struct("item", "w", "related")
        entries = items.groupBy("id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
        bags = entries.join(groups.select("id", "cls", "m"), "id")

    def of(a: Column, b: Column) -> Column:
        return (_hit_share(a, b) + _hit_share(b, a)) / 2

    found, open_pairs = _overlap_candidates(items, min_sim, related is not None)
    if min_sim > 0:
        left, right = _sides(bags.drop("cls", "m"), bags.drop("cls", "m"), ["entries"])
        both = open_pairs.join(left.withColumnRenamed("id", "p"), "p").join(right.withColumnRenamed("id", "q"), "q")
        found = found.unionByName(both.select("p", "q", of(F.col("entries_a"), F.col("entries_b")).alias("sim")))
    # Keys travel as bytes, half as long as their text.
    names = groups.select("id", F.unhex("cls").alias("cls"), "m")
    left, right = _sides(names, names, [])
    named = found.filter(F.col("sim") > min_sim).join(left.withColumnRenamed("id", "p"), "p").join(
        right.withColumnRenamed("id", "q"), "q").withColumns({c: F.lower(F.hex(c)) for c in "ab"})
    own = bags.filter("m > 1").withColumn("sim", _hit_share(F.col("entries"), F.col("entries")))
    inside = _inside(own, F.col("sim")).filter(F.col("sim") > min_sim)
    kind = "dense" if min_sim > 0 else "sparse"
    exact = Exact(bags.select("cls", F.col("entries").alias("value")), of)
    return Similarity(members.select("node_id", "cls"), _ordered(named).unionByName(inside), kind, min_sim, exact)


def _overlap_candidates(items: DataFrame, min_sim: float, expanded: bool) -> tuple[DataFrame, DataFrame]:
    """(p, q, sim) and (p, q), p < q: together every pair with similarity above ``min_sim``.

    ``items`` has (id, total, item, w[, related]). A bag probes with its rarest
    items until what is left weighs no more than min_sim * total less its
    heaviest item. Met items plus that rest bound both shares from above, so a
    pair with one chance hit is dropped before any bag is compared, and items
    found everywhere probe last. Where no unseen item can be shared, the met
    items are the shares themselves; only other pairs, the second table, are
    left to a comparison of bags. Hits travel as numbers, each shared item of a
    pair once.
    """
    need = F.col("total") * F.lit(min_sim / _SLACK)
    rows = items.withColumns({"left": F.lit(0.0), "probes": F.lit(True)})
    if min_sim > 0:
        frequency = items.groupBy("item").agg(F.count(F.lit(1)).alias("freq"))
        by_rarity = Window.partitionBy("id").orderBy("freq", "item")
        after = by_rarity.rowsBetween(1, Window.unboundedFollowing)
        bag = Window.partitionBy("id")
        rows = items.join(frequency, "item").withColumns({
            "_after": F.coalesce(F.sum("w").over(after), F.lit(0.0)), "_heaviest": F.max("w").over(bag),
        }).withColumn("probes", F.col("_after") + F.col("w") > need - F.col("_heaviest"))
        rows = materialize(rows.withColumn("left", F.min(F.when(F.col("probes"), F.col("_after"))).over(bag)).drop(
            "freq", "_after", "_heaviest"))
    sides = ["id", "total", "left", "w"]
    asking = rows.filter("probes")
    if expanded:
        one = asking.select(*[F.col(c).alias(f"{c}_x") for c in sides], F.col("item").alias("probe"), F.explode("related").alias("item"))
    else:
        one = asking.select(*[F.col(c).alias(f"{c}_x") for c in sides], "item")
    two = rows.select(*[F.col(c).alias(f"{c}_y") for c in sides], F.col("probes").alias("_probes"), "item")
    hits = one.join(two, "item").filter("id_x <> id_y")
    first = F.col("id_x") < F.col("id_y")

    def ordered(c: str, names: tuple[str, str]) -> list[Column]:
        x, y = F.col(f"{c}_x"), F.col(f"{c}_y")
        return [F.when(first, x).otherwise(y).alias(names[0]), F.when(first, y).otherwise(x).alias(names[1])]

    def met(hits: DataFrame, *more: str) -> DataFrame:
        pair = [*ordered("id", ("p", "q")), *ordered("total", ("tp", "tq")), *(c for m in more for c in ordered(m, ("lp", "lq")))]
        keys = ["p", "q", "tp", "tq", *(["lp", "lq"] if more else [])]
        if not expanded:  # where both probe with an item, the smaller id counts it
            each = hits.filter(first | ~F.col("_probes")).select(*pair, *ordered("w", ("wp", "wq")))
            return each.groupBy(*keys).agg(F.sum("wp").alias("wp"), F.sum("wq").alias("wq"))
        # An item that meets a bag through several related items counts once.
        each = hits.select(*pair, first.alias("_first"), "probe", F.col("w_x").alias("w")).repartition("p", "q")
        each = each.groupBy(*keys, "_first", "probe").agg(F.max("w").alias("w"))
        return each.groupBy(*keys).agg(
            F.sum(F.when(F.col("_first"), F.col("w")).otherwise(0.0)).alias("wp"),
            F.sum(F.when(F.col("_first"), F.lit(0.0)).otherwise(F.col("w"))).alias("wq"))

    known, unknown = "left_x = 0 or left_y = 0", "left_x > 0 and left_y > 0"
    if expanded:
        known, unknown = "left_x = 0 and left_y = 0", "left_x > 0 or left_y > 0"
    sim = (F.try_divide("wp", "tp") + F.try_divide("wq", "tq")) / 2
    at_most = (F.least(F.lit(1.0), (F.col("wp") + F.col("lp")) / F.col("tp"))
               + F.least(F.lit(1.0), (F.col("wq") + F.col("lq")) / F.col("tq"))) / 2
    found = met(hits.filter(known)).select("p", "q", sim.alias("sim")).filter(F.col("sim") > min_sim)
    return found, met(hits.filter(unknown), "left").filter(at_most > min_sim / _SLACK).select("p", "q")


# --- vectors ----------------------------------------------------------------

#: Vectors per block of the block-by-block product: every vector is sent to as many tasks as there are blocks.
COUNT_BLOCK = 16_384
#: Rows of a block multiplied at a time, so that memory does not grow with the square of a block.
_TILE = 512


def _vector_classes(nodes: DataFrame, vec_col: str, node: str) -> tuple[DataFrame, DataFrame]:
    unit = l2_normalize(F.transform(vec_col, lambda x: x.cast("double") + F.lit(0.0)))
    members = nodes.select(F.col(node).alias("node_id"), unit.alias("unit"))
    members = members.withColumn("cls", F.md5(F.to_json("unit")))
    nonzero = F.exists("unit", lambda x: x != 0)
    return members.select("node_id", "cls"), _classes(members, "unit").filter(nonzero)


def _half_neighbours(dims: int) -> list[tuple[int, ...]]:
    """The zero offset and one of each pair of opposite neighbour offsets."""
    from itertools import product

    return [o for o in product((-1, 0, 1), repeat=dims) if o >= (0,) * dims]


def _block_grid(groups: DataFrame, min_sim: float, grid_axes: list[int], block: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows (cell, left block, right block) that together cover every pair above ``min_sim``.

    Unit vectors with cosine > t are closer than sqrt(2 - 2t) on every axis, so
    cells of that width along ``grid_axes`` need only meet their neighbours. A
    cell with more than ``block`` vectors is dealt over blocks; blocks meet
    pairwise under an explicit (cell, i, j) key, so a crowded cell spreads over
    as many tasks as it has block pairs. Columns ``extra`` travel along.
    """
    width = max(math.sqrt(max(2.0 - 2.0 * min_sim, 0.0)) * _SLACK, 1e-9)
    home = F.array(*[F.floor(F.element_at("unit", d + 1) / F.lit(width)) for d in grid_axes]) if grid_axes else F.array().cast("array<bigint>")
    zero = (0,) * len(grid_axes)
    # The offsets are one literal: a plan with an expression for each of them takes the driver's memory.
    offsets = [(zero, 0, True)] + [(o, 1, o == zero) for o in _half_neighbours(len(grid_axes))]
    known = F.from_json(F.lit(json.dumps([{"o": o, "role": r, "home": h} for o, r, h in offsets])),
                        "array<struct<o: array<bigint>, role: int, home: boolean>>")

    def role(held, e):
        at = F.zip_with(held, e["o"], lambda h, o: (h - o).cast("string"))
        return F.struct(F.concat_ws(",", F.lit("c"), at).alias("cell"), e["role"].alias("role"), e["home"].alias("home"))

    roles = bound(home, lambda held: F.transform(known, lambda e: role(held, e)))
    return _meeting_blocks(groups, roles, ["cls", "m", *extra], "unit", block, halved=not grid_axes)


def _meeting_blocks(groups: DataFrame, roles: Column, kept: list[str], flat: str, block: int, halved: bool) -> DataFrame:
    """Rows (cell, left block, right block): classes with role 0 in a cell beside those with role 1.

    ``roles`` is an array of (cell, role, home) for a class, home where both roles of a pair are taken by both of
    its classes. The lists ``flat`` of a block are joined into one; ``kept`` holds the other columns that travel.
    """
    placed = groups.select(*kept, flat, F.explode(roles).alias("at")).select(*kept, flat, "at.*")
    sizes = placed.groupBy("cell").agg(
        F.count_if(F.col("role") == 0).alias("n0"), F.count_if(F.col("role") == 1).alias("n1")
    )
    crowded = sizes.filter(F.greatest("n0", "n1") > block)
    blocks = [F.ceil(F.greatest(F.col(f"n{r}"), F.lit(1)) / block).alias(f"k{r}") for r in (0, 1)]
    dealt = placed.join(crowded.select("cell", *blocks), "cell", "left")
    dealt = dealt.withColumns({k: F.coalesce(k, F.lit(1)).cast("long") for k in ("k0", "k1")})
    mine = F.when(F.col("role") == 0, F.col("k0")).otherwise(F.col("k1"))
    dealt = dealt.withColumn("no", F.pmod(F.xxhash64("cls"), mine))
    packed = dealt.groupBy("cell", "role", "no").agg(
        F.collect_list(F.struct(*kept, "home", flat)).alias("rows"),
        F.first("k0").alias("k0"), F.first("k1").alias("k1"),
    )

    def side(role: int, tag: str, own: str, other: str, count: str) -> DataFrame:
        def part(name):
            return F.transform("rows", lambda r: r[name]).alias(f"{name}_{tag}")

        return packed.filter(F.col("role") == role).select(
            "cell", F.col("no").alias(own),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1)).alias(other),
            *[part(c) for c in kept], part("home"),
            F.flatten(F.transform("rows", lambda r: r[flat])).alias(f"{flat}_{tag}"),
        )

    joined = side(0, "a", "i", "j", "k1").join(side(1, "b", "j", "i", "k0"), ["cell", "i", "j"])
    # Without neighbours both roles hold the same blocks, so half the grid is enough.
    return joined.filter("i <= j") if halved else joined


def _grid_products(batches, halved: bool):
    """Per joined block row: (class ids, sizes, cosine matrix, mask of pairs to count once)."""
    for _, _, _, *product in _grid_tiles(batches, halved):
        yield tuple(product)


def _grid_tiles(batches, halved: bool):
    """As :func:`_grid_products`, after the columns and number of the block row and the tile's place in its left block."""
    import numpy as np

    for batch in batches:
        col = {name: batch.column(name) for name in batch.schema.names}
        for r in range(batch.num_rows):
            cls_a, cls_b = col["cls_a"][r].values, col["cls_b"][r].values
            m_a = col["m_a"][r].values.to_numpy(zero_copy_only=False)
            m_b = col["m_b"][r].values.to_numpy(zero_copy_only=False)
            a = col["unit_a"][r].values.to_numpy(zero_copy_only=False).reshape(len(cls_a), -1)
            b = col["unit_b"][r].values.to_numpy(zero_copy_only=False).reshape(len(cls_b), -1)
            ids_a = cls_a.to_numpy(zero_copy_only=False)
            ids_b = cls_b.to_numpy(zero_copy_only=False)
            home = col["home_b"][r].values.to_numpy(zero_copy_only=False).astype(bool)
            same_block = col["i"][r].as_py() == col["j"][r].as_py()
            # Numbers in the order of the keys: comparing them is much cheaper.
            order = np.unique(np.concatenate([ids_a, ids_b]), return_inverse=True)[1]
            no_a, no_b = order[:len(ids_a)], order[len(ids_a):]
            for start in range(0, len(ids_a), _TILE):
                at = slice(start, start + _TILE)
                sims = a[at] @ b.T
                once = np.ones(sims.shape, dtype=bool)
                if same_block or not halved:
                    once[:, home] = no_a[at, None] < no_b[None, home]
                yield col, r, at, ids_a[at], ids_b, m_a[at], m_b, sims, once


def _emit_pairs(min_sim: float, halved: bool):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for ids_a, ids_b, m_a, m_b, sims, once in _grid_products(batches, halved):
            x, y = np.nonzero(once & (sims > min_sim))
            for start in range(0, len(x), 200_000):
                i, j = x[start:start + 200_000], y[start:start + 200_000]
                yield pa.RecordBatch.from_pydict({
                    "a": pa.array(ids_a[i], pa.string()), "b": pa.array(ids_b[j], pa.string()),
                    "sim": pa.array(sims[i, j], pa.float64()),
                    "m_a": pa.array(m_a[i], pa.int64()), "m_b": pa.array(m_b[j], pa.int64()),
                })

    return run


def _summed(mask, values):
    """``mask`` times ``values``; what is not finite reaches linked rows only."""
    import numpy as np

    finite = np.isfinite(values)
    if finite.all():
        return mask @ values
    out = mask @ np.where(finite, values, 0.0)
    high, low, none = ((mask @ at.astype(float)) > 0 for at in (values == np.inf, values == -np.inf, np.isnan(values)))
    out[high], out[low], out[none | (high & low)] = np.inf, -np.inf, np.nan
    return out


def _emit_sums(min_sim: float, halved: bool, width: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def rows(ids, sums, met):
            ids, sums = ids[met], sums[met]
            for start in range(0, len(ids), 10_000):
                at = slice(start, start + 10_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at], pa.string()), *(pa.array(c) for c in sums[at].T.copy())], ["cls", *(f"x{i}" for i in range(width))])

        for col, r, at, ids_a, ids_b, _, _, sims, once in _grid_tiles(batches, halved):
            if at.start == 0:
                x_a, x_b = (col[c][r].values.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) for c in ("x_a", "x_b"))
                sum_a, sum_b = np.zeros(x_a.shape), np.zeros(x_b.shape)
                met_a, met_b = np.zeros(len(x_a), dtype=bool), np.zeros(len(x_b), dtype=bool)
            linked = once & (sims > min_sim)
            met_a[at], met_b = linked.any(axis=1), met_b | linked.any(axis=0)
            linked = linked.astype(float)
            sum_a[at] += _summed(linked, x_b)
            sum_b += _summed(linked.T, x_a[at])
            if at.stop >= len(x_a):
                yield from rows(col["cls_a"][r].values.to_numpy(zero_copy_only=False), sum_a, met_a)
                yield from rows(ids_b, sum_b, met_b)

    return run


#: Labels of a block counted at a time.
_LABELS = 256


def _emit_labels(min_sim: float, halved: bool):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def flat(column, r):
            cells = column[r].values
            starts = cells.offsets.to_numpy()
            labels, n = cells.flatten().flatten()
            coded = labels.dictionary_encode(null_encoding="encode")
            return (np.repeat(np.arange(len(cells)), np.diff(starts)), coded.indices.to_numpy(), coded.dictionary,
                    n.to_numpy(zero_copy_only=False))

        for col, r, at, ids_a, ids_b, _, _, sims, once in _grid_tiles(batches, halved):
            if at.start == 0:
                row_a, code_a, names_a, n_a = flat(col["labels_a"], r)
                row_b, code_b, names_b, n_b = flat(col["labels_b"], r)
            linked = (once & (sims > min_sim)).astype(float)
            mine = (row_a >= at.start) & (row_a < at.stop)
            used, code = np.unique(code_a[mine], return_inverse=True)
            for first in range(0, len(used), _LABELS):
                some = (code >= first) & (code < first + _LABELS)
                own = np.zeros((min(_LABELS, len(used) - first), len(ids_a)))
                np.add.at(own, (code[some] - first, row_a[mine][some] - at.start), n_a[mine][some])
                reach = own @ linked
                for start in range(0, len(names_b), _LABELS):
                    held = (code_b >= start) & (code_b < start + _LABELS)
                    other = np.zeros((len(ids_b), min(_LABELS, len(names_b) - start)))
                    np.add.at(other, (row_b[held], code_b[held] - start), n_b[held])
                    met = reach @ other
                    i, j = np.nonzero(met)
                    yield pa.RecordBatch.from_arrays(
                        [names_a.take(pa.array(used[i + first])), names_b.take(pa.array(j + start)),
                         pa.array(met[i, j].round().astype(np.int64))], ["y_src", "y_dst", "n"])

    return run


def _emit_counts(scale: int, halved: bool, min_sim: float = -math.inf):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        counts = np.zeros(scale + 2, dtype=np.int64)  # of the whole task
        for _, _, m_a, m_b, sims, once in _grid_products(batches, halved):
            once &= sims > min_sim
            slot = np.clip(np.ceil(sims[once] * scale), 0, scale + 1).astype(np.int64)
            np.add.at(counts, slot, (m_a[:, None] * m_b[None, :])[once])
        found = np.flatnonzero(counts)
        for start in range(0, len(found), 200_000):
            slots = found[start:start + 200_000]
            yield pa.RecordBatch.from_pydict({
                "slot": pa.array(slots, pa.int64()), "n": pa.array(counts[slots], pa.int64()),
            })

    return run


def _emit_extremes(min_sim: float, halved: bool):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        low, high = np.inf, -np.inf  # of the whole task
        for *_, sims, once in _grid_products(batches, halved):
            once &= sims > min_sim
            low = min(low, sims.min(initial=np.inf, where=once))
            high = max(high, sims.max(initial=-np.inf, where=once))
        if low <= high:
            yield pa.RecordBatch.from_pydict({"lo": pa.array([low]), "hi": pa.array([high])})

    return run


def _emit_nodes(min_sim: float, halved: bool):
    """Node pairs of joined blocks whose rows are parts of classes, key "class:part", with the ids of their members."""
    def run(batches):
        import numpy as np

        block = None
        for col, r, at, keys_a, keys_b, _, _, sims, once in _grid_tiles(batches, halved):
            if at.start == 0:
                block = _id_lists(col["ids_a"], r), _id_lists(col["ids_b"], r)
                names = np.array([k[:32] for k in [*col["cls_a"][r].values.to_pylist(), *keys_b]])
                cls = np.unique(names, return_inverse=True)[1]
                cls_a, cls_b = cls[:-len(keys_b)], cls[-len(keys_b):]
                # Rows of one class are equal vectors in one cell: each part pair once, a part with itself.
                home = col["home_b"][r].values.to_numpy(zero_copy_only=False).astype(bool)
                met = bool(np.isin(cls_a, cls_b[home]).any())
            (ids_a, start_a, n_a), (ids_b, start_b, n_b) = block
            kept = once & (sims > min_sim)
            equal = own = np.zeros((1, 1), dtype=bool)
            if met:
                equal = (cls_a[at, None] == cls_b) & home
                own = np.zeros_like(equal)
                i, j = np.nonzero(equal)
                own[i, j] = keys_a[i] == keys_b[j]
                sims = np.where(equal, 1.0, sims)
                kept |= (once & equal) | own
            x, y = np.nonzero(kept)
            equal, own = (np.broadcast_to(m, kept.shape) for m in (equal, own))
            value, same, itself = sims[x, y], equal[x, y], own[x, y]
            yield from _node_rows((ids_a, start_a, n_a), (ids_b, start_b, n_b), x + at.start, y, value, same, itself)

    return run


def _node_rows(one, two, x, y, sim, same=None, itself=None):
    """Batches (src, dst, sim) of the node pairs that pairs (x, y) of rows stand for.

    ``one`` and ``two`` are (ids, starts, counts) of the rows on either side. ``same`` marks pairs of rows
    inside a class, ``itself`` those of a row with itself.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    (ids_a, start_a, n_a), (ids_b, start_b, n_b) = one, two
    ends = np.cumsum(n_a[x] * n_b[y])
    cut = 0
    while cut < len(x):
        done = ends[cut - 1] if cut else 0
        to = max(cut + 1, int(np.searchsorted(ends, done + 200_000, side="right")))
        i, j = x[cut:to], y[cut:to]
        reps = n_a[i] * n_b[j]
        pair = np.repeat(np.arange(len(i)), reps)
        place = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        width = n_b[j][pair]
        left = ids_a.take(pa.array(start_a[i][pair] + place // width))
        right = ids_b.take(pa.array(start_b[j][pair] + place % width))
        src, dst = pc.min_element_wise(left, right), pc.max_element_wise(left, right)
        rows = pa.RecordBatch.from_arrays([src, dst, pa.array(sim[cut:to][pair])], ["src", "dst", "sim"])
        inside = None if same is None else same[cut:to][pair]
        if inside is not None and inside.any():
            # Inside a class no node meets itself, and a part with itself gives each pair once.
            less = pc.fill_null(pc.less(left, right), False).to_numpy(zero_copy_only=False)
            more = pc.fill_null(pc.greater(left, right), False).to_numpy(zero_copy_only=False)
            rows = rows.filter(pa.array(~inside | less | (more & ~itself[cut:to][pair])))
        yield rows
        cut = to


def _id_lists(column, r: int):
    """(ids, starts, counts) of row r of a column of lists of (node_id)."""
    import numpy as np

    cells = column[r].values
    starts = cells.offsets.to_numpy()
    return cells.flatten().flatten()[0], starts[:-1] - starts[0], np.diff(starts)


#: Members of a class that travel together where node pairs are written.
_PART = 64


def _parts(members: DataFrame, limit: int) -> DataFrame:
    """(cls, part, ids): the members of a class in lists of about ``limit``."""
    return split_hot(members.filter("cls is not null"), ["cls"], ["node_id"], limit).groupBy("cls", "part").agg(
        F.collect_list(F.struct("node_id")).alias("ids"))


@dataclass(frozen=True)
class Vectors:
    """Distinct unit vectors (cls, m, unit), each block of them multiplied with each where their cells meet.

    Blocks travel, pairs do not: node pairs are written where they are found, and
    counts and sums leave a block as counts and sums.
    """

    members: DataFrame
    groups: DataFrame
    axes: tuple[int, ...]
    block: int

    def grid(self, groups: DataFrame, min_sim: float, *extra: str) -> DataFrame:
        if extra:  # a grid reads its vectors three times
            groups = materialize(groups)
        return _block_grid(groups, min_sim, list(self.axes), self.block, extra)

    def node_pairs(self, min_sim: float) -> DataFrame:
        """(src, dst, sim), src < dst, of every node pair above ``min_sim``, and of equal vectors."""
        dealt = _parts(self.members, _PART).join(self.groups, "cls").select(
            F.concat_ws(":", "cls", "part").alias("cls"), "m", "unit", "ids")
        kind = self.members.schema["node_id"].dataType.simpleString()
        return self.grid(dealt, min_sim, "ids").mapInArrow(
            _emit_nodes(min_sim, not self.axes), f"src {kind}, dst {kind}, sim double")

    def materialized(self) -> "Vectors":
        """Vectors written once, for consumers that multiply them several times."""
        return replace(self, members=materialize(self.members), groups=materialize(self.groups))

    def class_pairs(self, min_sim: float) -> DataFrame:
        """(a, b, sim, m_a, m_b) of every pair of different classes above ``min_sim``, each once."""
        return self.grid(self.groups, min_sim).mapInArrow(
            _emit_pairs(min_sim, not self.axes), "a string, b string, sim double, m_a long, m_b long")

    def extremes(self, min_sim: float) -> DataFrame:
        """One row (lo, hi) of the cosines of different classes above ``min_sim``; null without any."""
        found = self.grid(self.groups, min_sim).mapInArrow(_emit_extremes(min_sim, not self.axes), "lo double, hi double")
        return found.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    def linked_sums(self, values: DataFrame, width: int, min_sim: float) -> DataFrame:
        """(cls, x0, x1, ...): sums of ``values`` (cls, x: array of ``width``) over all other classes above ``min_sim``."""
        grid = self.grid(self.groups.join(values, "cls"), min_sim, "x")
        names = [f"x{i}" for i in range(width)]
        sums = grid.mapInArrow(_emit_sums(min_sim, not self.axes, width), ", ".join(["cls string", *(f"{n} double" for n in names)]))
        return sums.groupBy("cls").agg(*[F.sum(n).alias(n) for n in names])

    def linked_labels(self, counts: DataFrame, min_sim: float) -> DataFrame:
        """(y_src, y_dst, n): ordered node pairs of different classes above ``min_sim``, by the labels of ``counts`` (cls, y, n)."""
        held = counts.groupBy("cls").agg(F.collect_list(F.struct("y", F.col("n").cast("double").alias("n"))).alias("labels"))
        kind = counts.schema["y"].dataType.simpleString()
        met = self.grid(self.groups.join(held, "cls"), min_sim, "labels").mapInArrow(
            _emit_labels(min_sim, not self.axes), f"y_src {kind}, y_dst {kind}, n long")
        ways = F.array(F.struct("y_src", "y_dst"), F.struct(F.col("y_dst").alias("y_src"), F.col("y_src").alias("y_dst")))
        return met.select(F.inline(ways), "n").groupBy("y_src", "y_dst").agg(F.sum("n").alias("n"))

    def histogram(self, scale: int, min_sim: float = -math.inf) -> DataFrame:
        """(slot, n): number of node pairs per ceil(cosine * scale), cosines below 0 in slot 0."""
        grid = self.grid(self.groups, max(min_sim, -1.0))
        counts = grid.mapInArrow(_emit_counts(scale, not self.axes, min_sim), "slot long, n long")
        inside = self.groups.select(
            F.lit(scale).cast("long").alias("slot"),
            F.shiftright(F.col("m") * (F.col("m") - 1), 1).alias("n"),
        )
        total = counts.unionByName(inside).groupBy("slot").agg(F.sum("n").alias("n"))
        return total.filter("n > 0")


def sim_cosine(
    nodes: DataFrame, vec_col: str, min_sim: float, node: str = "node_id",
    grid_axes: list[int] = (), block: int = COUNT_BLOCK,
) -> Similarity:
    """Cosine of all pairs above ``min_sim``, exact; a zero vector has similarity 0.

    ``grid_axes`` are vector positions to cut space along; useful when vectors
    have few dimensions or concentrate on them.
    """
    members, groups = _vector_classes(nodes, vec_col, node)
    vectors = Vectors(members, groups, tuple(grid_axes), block)
    inside = _inside(groups, F.lit(1.0))
    return Similarity(members, _ordered(vectors.class_pairs(min_sim)).unionByName(inside), "dense", min_sim, _cosine_access(groups), vectors)


def _cosine_access(groups: DataFrame) -> Exact:
    def of(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)

    return Exact(groups.select("cls", F.col("unit").alias("value")), of)


def cosine_histogram(
    nodes: DataFrame, vec_col: str, scale: int, node: str = "node_id", block: int = COUNT_BLOCK
) -> DataFrame:
    """(slot, n): number of node pairs per ceil(cosine * scale), cosines below 0 in slot 0.

    Only counts leave each block, never pairs.
    """
    return Vectors(*_vector_classes(nodes, vec_col, node), (), block).histogram(scale)


def _emit_bucketed(min_sim: float, nodes: bool = False):
    """Pairs above ``min_sim`` of blocks of a bucket, cell "table:bucket"; only the first table where a pair shares one gives it.

    Pairs of classes, or of the ``nodes`` listed in ids.
    """
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for col, r, at, ids_a, ids_b, m_a, m_b, sims, once in _grid_tiles(batches, True):
            if at.start == 0:
                table = int(col["cell"][r].as_py().split(":")[0])
                hash_a, hash_b = (np.stack(col[f"hashes_{s}"][r].values.to_numpy(zero_copy_only=False)) for s in "ab")
                lists = [_id_lists(col[f"ids_{s}"], r) for s in "ab"] if nodes else None
            x, y = np.nonzero(once & (sims > min_sim))
            for start in range(0, len(x), 200_000):
                i, j = x[start:start + 200_000], y[start:start + 200_000]
                first = (hash_a[at][i] == hash_b[j]).argmax(axis=1) == table
                i, j = i[first], j[first]
                if nodes:
                    yield from _node_rows(lists[0], lists[1], i + at.start, j, sims[i, j])
                    continue
                yield pa.RecordBatch.from_pydict({
                    "a": pa.array(ids_a[i], pa.string()), "b": pa.array(ids_b[j], pa.string()),
                    "sim": pa.array(sims[i, j], pa.float64()),
                    "m_a": pa.array(m_a[i], pa.int64()), "m_b": pa.array(m_b[j], pa.int64()),
                })

    return run


def sim_cosine_lsh(
    nodes: DataFrame, vec_col: str, min_sim: float, node: str = "node_id",
    bucket_length: float = 0.5, tables: int = 8, seed: int = 17, block: int = COUNT_BLOCK,
) -> Similarity:
    """X13, approximate candidates: random-projection buckets, cosines exact; may miss pairs.

    Vectors of a bucket meet in blocks, so candidates are never rows: a pair is looked at in
    each table where it shares a bucket, and written once, if it is above ``min_sim``.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    members, groups = _vector_classes(nodes, vec_col, node)
    groups = materialize(groups)
    vectors = groups.withColumn("v", array_to_vector("unit"))
    model = BucketedRandomProjectionLSH(
        inputCol="v", outputCol="h", bucketLength=bucket_length, numHashTables=tables, seed=seed
    ).fit(vectors)
    bucket = [vector_to_array(F.element_at("h", t + 1))[0].cast("long") for t in range(tables)]
    hashed = model.transform(vectors).select("cls", "m", "unit", F.array(*bucket).alias("hashes"))
    roles = F.flatten(F.transform("hashes", lambda h, t: F.transform(F.array(F.lit(0), F.lit(1)), lambda role: F.struct(
        F.concat_ws(":", t, h).alias("cell"), role.alias("role"), F.lit(True).alias("home")))))
    met = _meeting_blocks(hashed, roles, ["cls", "m", "hashes"], "unit", block, halved=True)
    near = met.mapInArrow(_emit_bucketed(min_sim), "a string, b string, sim double, m_a long, m_b long")
    inside = _inside(groups, F.lit(1.0))
    kind = members.schema["node_id"].dataType.simpleString()

    def found() -> DataFrame:
        dealt = _parts(members, _PART).join(hashed, "cls")
        blocks = _meeting_blocks(dealt, roles, ["cls", "m", "hashes", "ids"], "unit", block, halved=True)
        across = blocks.mapInArrow(_emit_bucketed(min_sim, True), f"src {kind}, dst {kind}, sim double")
        return expand_pairs(members, inside).unionByName(across)

    return Similarity(members, near.unionByName(inside), "dense", min_sim, _cosine_access(groups), found=found)
