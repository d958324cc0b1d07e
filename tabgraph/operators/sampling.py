"""Seeded sampling (R1-R3) and splits (M1-M3).

Draws are ordered by ``md5(seed | key)``: exact sizes, the same rows whatever the
partitioning, and reproducible in any SQL engine.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabgraph.distributed import hash_rank, hash_smallest, ordered_index, seeded_hash, with_scalars
from tabgraph.operators.rows import require_columns, require_ratios


def _draws(df: DataFrame, n_files: int) -> DataFrame:
    return df.withColumn("sample_no", F.explode(F.sequence(F.lit(0), F.lit(n_files - 1))))


def _digest(seed: int, keys: list[str]):
    return seeded_hash(F.lit(seed) + F.col("sample_no"), *keys)


def sample_n(df: DataFrame, n: int, keys: list[str], seed: int = 123) -> DataFrame:
    """``min(n, available)`` rows without replacement; ``draw_no`` is the shuffled order."""
    return hash_smallest(df, seeded_hash(seed, *keys), keys, n)


def sample_repeated(df: DataFrame, n: int, n_files: int, keys: list[str], seed: int = 123) -> DataFrame:
    """``n_files`` independent draws with seeds seed, seed+1, ...; they may overlap."""
    return hash_smallest(_draws(df, n_files), _digest(seed, keys), keys, n, by=["sample_no"])


def class_quotas(df: DataFrame, n: int, ratio: float, label: str) -> DataFrame:
    """R2: rows to draw per class (label, quota); one class's shortfall goes to the other."""
    target1 = int(n * ratio)
    target0 = n - target1
    have = df.agg(
        F.count_if(F.col(label) == 1).alias("have1"), F.count_if(F.col(label) == 0).alias("have0")
    )
    short1 = F.greatest(F.lit(target1) - F.col("have1"), F.lit(0))
    short0 = F.greatest(F.lit(target0) - F.col("have0"), F.lit(0))
    take1 = F.least(F.lit(target1) + F.when(short1 > 0, 0).otherwise(short0), F.col("have1"))
    take0 = F.least(F.lit(target0) + short1, F.col("have0"))
    label_type = df.schema[label].dataType
    rows = F.array(
        F.struct(F.lit(1).cast(label_type).alias(label), take1.alias("quota")),
        F.struct(F.lit(0).cast(label_type).alias(label), take0.alias("quota")),
    )
    return have.select(F.inline(rows))


def sample_stratified(
    df: DataFrame, n: int, ratio: float, keys: list[str], label: str = "churn",
    n_files: int = 1, seed: int = 123,
) -> DataFrame:
    """R2 (+R3): draws with a target share of class 1."""
    quotas = class_quotas(df, n, ratio, label)
    draws = _draws(df.filter(F.col(label).isin(0, 1)), n_files)
    per_draw = _draws(quotas, n_files)
    return hash_smallest(draws, _digest(seed, keys), keys, per_draw, by=["sample_no", label])


def _named_split(rank, first, second):
    return F.when(rank < first, "train").when(rank < second, "val").otherwise("test")


def _split_by_rank(df: DataFrame, rank: str, train: float, val: float) -> DataFrame:
    size = df.agg(F.count(F.lit(1)).alias("_n"))
    first = (F.col("_n") * F.lit(train)).cast("long")
    second = first + (F.col("_n") * F.lit(val)).cast("long")
    return with_scalars(df, size).withColumn(
        "split", _named_split(F.col(rank), first, second)
    ).drop("_n")


def split_rowwise(nodes: DataFrame, node: str = "node_id", train: float = 0.8, val: float = 0.1) -> DataFrame:
    """M1: cut along the dense node id; sizes are truncated, the rest is test."""
    return _split_by_rank(nodes, node, train, val)


def split_temporal(
    nodes: DataFrame, ts: str = "timestamp", node: str = "node_id",
    train: float = 0.8, val: float = 0.1,
) -> DataFrame:
    """M2: the same cuts along time; equal times are ordered by node id."""
    require_ratios(train, val)
    require_columns(nodes, [ts, node], not_empty=True)
    ranked = ordered_index(nodes, [ts, node], "_rank")
    return _split_by_rank(ranked, "_rank", train, val).drop("_rank")


def _largest_remainder(classes: DataFrame, size: str, total, draws, name: str) -> DataFrame:
    """Share ``draws`` over the class sizes proportionally, rounding by largest remainder."""
    share = F.col(size) / total * draws
    base = classes.withColumns({"_floor": F.floor(share), "_rest": share - F.floor(share)})
    everything = Window.partitionBy()  # one row per class
    rank = F.row_number().over(everything.orderBy(F.desc("_rest"), "_class"))
    left_over = draws - F.sum("_floor").over(everything)
    return base.withColumn(
        name, F.col("_floor") + F.when(rank <= left_over, 1).otherwise(0)
    ).drop("_floor", "_rest")


def stratified_quotas(nodes: DataFrame, label: str, train: float, val: float) -> DataFrame:
    """M3: rows per class going to train, val and test: (label, n_train, n_val)."""
    held_out = 1 - train
    test_share = 1 - val / held_out
    classes = nodes.groupBy(F.col(label).alias("_class")).agg(F.count(F.lit(1)).alias("_size"))
    n = F.sum("_size").over(Window.partitionBy())
    classes = classes.withColumn("_n", n).withColumn(
        "_tmp", F.ceil(F.col("_n") * F.lit(held_out))
    ).withColumn("_test", F.ceil(F.col("_tmp") * F.lit(test_share)))
    cut = _largest_remainder(classes, "_size", F.col("_n"), F.col("_n") - F.col("_tmp"), "n_train")
    cut = cut.withColumn("_rest_size", F.col("_size") - F.col("n_train"))
    cut = _largest_remainder(
        cut, "_rest_size", F.col("_tmp"), F.col("_tmp") - F.col("_test"), "n_val"
    )
    return cut.select(F.col("_class").alias(label), "n_train", "n_val")


def split_stratified(
    nodes: DataFrame, label: str, node: str = "node_id", train: float = 0.8, val: float = 0.1,
    seed: int = 123,
) -> DataFrame:
    """M3: per-class proportional split with exact sizes; membership by seeded hash.

    Rows without a label stay, with a null split, and count in no class.
    """
    require_ratios(train, val)
    if math.isclose(train, 1.0):
        return nodes.withColumn("split", F.lit("train"))
    labelled = nodes.filter(F.col(label).isNotNull())
    quotas = stratified_quotas(labelled, label, train, val)
    ranked = hash_rank(labelled, seeded_hash(seed, node), [node], "_rank", by=[label])
    cut = _named_split(F.col("_rank"), F.col("n_train"), F.col("n_train") + F.col("n_val"))
    # `quotas` has one row per class.
    split = ranked.join(quotas, label).withColumn("split", cut).drop("_rank", "n_train", "n_val")
    rest = nodes.filter(F.col(label).isNull()).withColumn("split", F.lit(None).cast("string"))
    return split.select(*nodes.columns, "split").unionByName(rest)
