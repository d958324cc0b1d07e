"""List cells: keys inside a window, and their expansion over a dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabgraph.operators.joins import window_join

def implode(order: list[str], values: list[str]) -> Column:
    """Ordered list of structs; the struct keeps null values in place."""
    packed = F.struct(*[F.col(c) for c in dict.fromkeys([*order, *values])])
    return F.array_sort(F.collect_list(packed))


def field(name: str):
    """Accessor of one struct field, for use in transform."""
    return lambda packed: packed[name]


def window_items(
    train: DataFrame, facts: DataFrame, entity: str, values: list[str], ts: str, fact_ts: str,
    window: str, node: str = "node_id",
) -> DataFrame:
    """The long form of A7: one row (node, fact time, values...) per fact in the window.

    Consumers that aggregate should take this form: it has no cell to outgrow.
    """
    kept = facts.select(*dict.fromkeys([entity, fact_ts, *values]))
    matched = window_join(train.select(node, entity, ts), kept, entity, ts, fact_ts, window)
    return matched.select(node, *dict.fromkeys([fact_ts, *values]))


def key_lists(
    train: DataFrame, facts: DataFrame, entity: str, value: str, ts: str, fact_ts: str,
    window: str, order: list[str], node: str = "node_id",
) -> DataFrame:
    """Per node the list of ``value`` inside the window, duplicates kept, [] when none.

    Ordered by ``order``, one row per node whatever its length. A cell is one value of one row;
    what must not gather a node's facts in one place takes :func:`window_items` instead.
    """
    kept = [c for c in dict.fromkeys([*order, value]) if c != fact_ts]
    matched = window_items(train, facts, entity, kept, ts, fact_ts, window, node)
    cells = matched.groupBy(node).agg(
        F.transform(implode(order, [value]), field(value)).alias(value)
    )
    empty = F.array().cast(dict(cells.dtypes)[value])
    return train.join(cells, node, "left").withColumn(value, F.coalesce(F.col(value), empty))


def expand_columns(
    cells: DataFrame, dimension: DataFrame, key: str, columns: list[str], prefix: str,
    node: str = "node_id",
) -> DataFrame:
    """Each list of keys becomes one aligned list per dimension column, all in one pass.

    Same length and order as the key list; a key without a dimension row gives
    null, an empty list gives ``[null]``.
    """
    items = cells.select(node, F.posexplode_outer(key).alias("_pos", key))
    looked_up = items.join(dimension.select(key, *columns), key, "left")
    packed = looked_up.groupBy(node).agg(implode(["_pos"], columns).alias("_items"))
    lists = packed.select(
        node,
        *[F.transform("_items", field(c)).alias(f"{prefix}_{c}") for c in columns],
    )
    return cells.join(lists, node, "left")


def value_counts(items: DataFrame, node: str, item: str) -> DataFrame:
    """A10: multiplicity of each item in a node's bag, nulls dropped (long form in and out)."""
    return (
        items.filter(F.col(item).isNotNull())
        .groupBy(node, item)
        .agg(F.count(F.lit(1)).alias("weight"))
    )
