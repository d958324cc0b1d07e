"""Scaling, binning, label and score functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabgraph.distributed import with_scalars

#: Standard deviations below this share of the mean are rounding noise of a constant.
_CONSTANT = 1e-13


def minmax_scale(df: DataFrame, column: str, name: str) -> DataFrame:
    """(x - min) / (max - min); NaN and null give 0, as does a constant or non-finite range."""
    from tabgraph.operators.rows import global_range

    x = F.col(column).cast("double")
    span = F.col("hi") - F.col("lo")
    usable = (span > 0) & (span < F.lit(float("inf")))
    scaled = F.when(usable & ~F.isnan(x), F.try_divide(x - F.col("lo"), span))
    return with_scalars(df, global_range(df, column)).withColumn(
        name, F.coalesce(scaled, F.lit(0.0))
    ).drop("lo", "hi")


def standard_scale(
    df: DataFrame, columns: list[str], fit_where: Column | None = None, suffix: str = ""
) -> DataFrame:
    """Z-scores with population deviation, fitted on the rows of ``fit_where``.

    A constant column is only centred.
    """
    fitted = df if fit_where is None else df.filter(fit_where)
    stats = fitted.agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns],
    )
    scaled = {}
    for c in columns:
        mean, std = F.col(f"_m_{c}"), F.col(f"_s_{c}")
        unit = F.when(std > F.abs(mean) * _CONSTANT, std).otherwise(F.lit(1.0))
        scaled[f"{c}{suffix}"] = (F.col(c) - mean) / unit
    drop = [f"_{k}_{c}" for c in columns for k in "ms"]
    return with_scalars(df, stats).withColumns(scaled).drop(*drop)


def log_degree_bin(degree: Column, n_nodes: Column) -> Column:
    """floor(log10(degree + 1)), capped at ceil(log10(n)); exact by counting digits."""
    digits = F.length((degree + 1).cast("string")) - 1
    return F.least(digits, degree_bins(n_nodes) - 1).cast("int")


def degree_bins(n_nodes: Column) -> Column:
    """Number of degree bins for n nodes: ceil(log10(n)) + 1."""
    return F.length((n_nodes - 1).cast("string")) + F.when(n_nodes > 1, 1).otherwise(0)


def one_hot(bin_no: Column, size: int, prefix: str) -> dict[str, Column]:
    """``size`` 0/1 columns."""
    return {f"{prefix}{i}": (bin_no == i).cast("double") for i in range(size)}


def stable_key(column: Column, data_type: T.DataType) -> Column:
    """Text key of a category; null and NaN share one key that no value has."""
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        column = F.nanvl(column, F.lit(None).cast(data_type))
    return F.when(column.isNull(), F.lit("missing")).otherwise(
        F.concat(F.lit("="), column.cast("string"))
    )


def label_codes(df: DataFrame, label: str, num_classes: int) -> DataFrame:
    """(label, code) for the sorted distinct labels; raises unless there are ``num_classes``."""
    from tabgraph.operators.rows import distinct_labels

    found = distinct_labels(df, label).limit(num_classes + 1).count()
    if found != num_classes:
        raise ValueError(f"{num_classes} classes declared, data has {'more' if found > num_classes else found}")
    # One row per class.
    rank = F.row_number().over(Window.partitionBy().orderBy(label)) - 1
    return distinct_labels(df, label).withColumn("code", rank.cast("int"))


def remap_labels(df: DataFrame, label: str, num_classes: int) -> DataFrame:
    """Labels replaced by 0..C-1 in sorted order."""
    codes = label_codes(df, label, num_classes)
    return df.join(F.broadcast(codes), label).drop(label).withColumnRenamed("code", label)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, however often and deep ``use`` reads it.

    Inside a lambda over array elements, an outer expression is otherwise evaluated per element.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def sigmoid(score: Column) -> Column:
    """T20."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def softmax(scores: Column) -> Column:
    """T20 on an array of scores, shifted by its maximum."""
    raised = bound(
        F.struct(scores.alias("s"), F.array_max(scores).alias("top")),
        lambda v: F.transform(v["s"], lambda s: F.exp(s - v["top"])))
    total = lambda r: F.aggregate(r, F.lit(0.0), lambda acc, x: acc + x)
    return bound(raised, lambda r: bound(
        F.struct(r.alias("r"), total(r).alias("total")),
        lambda v: F.transform(v["r"], lambda x: x / v["total"])))


def argmax(scores: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def l2_normalize(vector: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x))
    return bound(F.struct(vector.alias("v"), length.alias("length")), lambda b: F.transform(
        b["v"], lambda x: F.coalesce(F.try_divide(x.cast("double"), b["length"]), F.lit(0.0))))
