"""Point-in-time joins (J1-J6): windowed, as-of and existence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgraph.distributed import last_known
from tabgraph.functions.timewin import Offset, as_offset, day_bucket, offset_by, window_predicate


def enrich(facts: DataFrame, dimension: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left join to the needed dimension columns; repeated dimension keys fan out.

    The join strategy is left to AQE, which broadcasts a dimension only below its
    size threshold and splits skewed keys otherwise.
    """
    return facts.join(dimension.select(key, *columns), key, "left")


def window_join(
    train: DataFrame,
    facts: DataFrame,
    key: str,
    ts: str,
    fact_ts: str,
    window: str | Offset,
    bucket_days: int | None = None,
) -> DataFrame:
    """J3, matched rows only: facts of the same entity inside ``[ts + window, ts)``.

    Both sides carry a time slot in the equi-join key, so an entity with a huge
    history is cut over its slots and non-overlapping times never meet. The
    training side is repeated once per slot its window touches, three at most by
    default; each fact is shuffled once. Row counts after an explode are unknown
    to the planner, which would broadcast millions of repeated rows as if they
    were the few before it, so the join is asked to merge.
    """
    offset = as_offset(window)
    width = bucket_days or max(1, offset.approx_days // 2)
    first = day_bucket(offset_by(ts, offset), width)
    last = day_bucket(F.col(ts), width)
    left = train.withColumn("_slot", F.explode(F.sequence(first, last)))
    right = facts.withColumn("_slot", day_bucket(F.col(fact_ts), width))
    joined = left.hint("merge").join(right, [key, "_slot"])
    return joined.filter(window_predicate(F.col(fact_ts), F.col(ts), offset)).drop("_slot")


def window_join_left(
    train: DataFrame, facts: DataFrame, key: str, ts: str, fact_ts: str,
    window: str | Offset, node: str, bucket_days: int | None = None,
) -> DataFrame:
    """J3 keeping training rows without a match (J1 semantics); ``node`` is their unique id."""
    matched = window_join(train, facts, key, ts, fact_ts, window, bucket_days)
    extra = [c for c in facts.columns if c != key]
    return train.join(matched.select(node, *extra), node, "left")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_ts: str,
    right_ts: str,
) -> DataFrame:
    """For each left row the latest right row of the same key with ``right_ts <= left_ts``.

    Left rows without a match, with a null key or without a time keep nulls. Both sides are laid
    out by key and time, and every row takes the last fact before it (:func:`last_known`): an entity
    with a third of all facts, even in one instant, is cut over many tasks, and no row is repeated.
    """
    payload = [right_ts] + [c for c in right.columns if c not in (*by, right_ts)]
    # Equal times resolve to the greatest remaining payload.
    packed = F.struct(*[F.col(c) for c in payload])
    # A null key equals nothing, and a fact without a time is never before a row.
    facts = right.dropna(how="any", subset=[*by, right_ts]).select(
        *by, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), packed.alias("_fact"))
    whole = F.lit(True)
    for c in (*by, left_ts):
        whole = whole & F.col(c).isNotNull()
    row = F.struct(*[F.col(c) for c in left.columns]).alias("_row")
    rows = left.filter(whole).select(*by, F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), row)
    both = facts.unionByName(rows, allowMissingColumns=True)
    known = last_known(both, by, ["_t", "_side", "_fact"], "_fact", "_best").filter("_side = 1")
    alone = left.filter(~whole).select(row, F.lit(None).cast(facts.schema["_fact"].dataType).alias("_best"))
    return known.select("_row", "_best").unionByName(alone).select(
        "_row.*", *[F.col(f"_best.{c}").alias(c) for c in payload])


def window_exists(
    left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str,
    window: str | Offset | None = None,
) -> DataFrame:
    """Rows with some fact in ``[ts - window, ts]``, or any ``<= ts`` without a window.

    A duration given with a plus sign looks back, as in the sampler. Facts shrink to their first and
    last time per entity and time slot, combined before any shuffle, so no entity's history is sorted
    or gathered: slots between the ends of a window hold a fact wherever they have a row, and the two
    end slots are settled by those times. Rows with a null key or time match nothing.
    """
    known = right.dropna(how="any", subset=[*by, right_ts])
    if window is None:
        first = known.groupBy(*by).agg(F.min(right_ts).alias("_first"))
        return left.join(first, by).filter(F.col("_first") <= F.col(left_ts)).select(*left.columns)
    offset = as_offset(window)
    offset = offset if offset.is_backward else offset.negated()
    if abs(offset.months) * 28 + abs(offset.days) + abs(offset.seconds) // 86400 < 1:
        # Under a day, which is the shortest slot: the latest fact decides.
        matched = asof_join(left, known.select(*by, right_ts), by, left_ts, right_ts)
        return matched.filter(F.col(right_ts) >= offset_by(left_ts, offset)).select(*left.columns)
    width = max(1, offset.approx_days // 6)
    cells = known.groupBy(*by, day_bucket(F.col(right_ts), width).alias("_slot")).agg(
        F.min(right_ts).alias("_first"), F.max(right_ts).alias("_last"))
    # Rows of one key and time are asked for once.
    asked = left.select(*by, F.col(left_ts).alias("_t")).dropna().distinct().withColumn("_low", offset_by("_t", offset))
    asked = asked.withColumns({"_a": day_bucket(F.col("_low"), width), "_z": day_bucket(F.col("_t"), width)})
    spread = asked.withColumn("_slot", F.explode(F.sequence("_a", "_z")))
    # The window is as long as a slot or longer, so its ends lie in different slots.
    inside = F.when(F.col("_slot") == F.col("_a"), F.col("_last") >= F.col("_low")).when(
        F.col("_slot") == F.col("_z"), F.col("_first") <= F.col("_t")).otherwise(True)
    # As in window_join: the planner takes the repeated rows for few.
    found = spread.hint("merge").join(cells, [*by, "_slot"]).filter(inside).select(*by, F.col("_t").alias(left_ts)).distinct()
    return left.join(found, [*by, left_ts], "left_semi").select(*left.columns)


def attach(base: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of per-group results back to every base row; null keys do not match."""
    return base.join(values, keys, "left")


def self_pairs(nodes: DataFrame, band: list[str], node: str = "node_id") -> DataFrame:
    """Unordered node pairs that share ``band``; never a bare cross join.

    A pair can arise twice only between two nodes that both have several bands; only such pairs are
    compared with each other, all others are written as they are found.
    """
    rows = nodes.select(*band, node).distinct()
    bands = rows.groupBy(F.col(node).alias("_id")).agg((F.count(F.lit(1)) > 1).alias("_many"))
    rows = rows.join(bands, F.col(node).eqNullSafe(F.col("_id"))).drop("_id")
    one = rows.withColumnsRenamed({node: "src", "_many": "_many_src"})
    two = rows.withColumnsRenamed({node: "dst", "_many": "_many_dst"})
    # A merge join holds the rows of one band of one side and may spill them.
    met = one.join(two.hint("merge"), band).filter("src < dst")
    again = F.col("_many_src") & F.col("_many_dst")
    return met.filter(~again).select("src", "dst").unionByName(met.filter(again).select("src", "dst").distinct())
