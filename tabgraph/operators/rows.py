"""Row-level filters, checks and top-k reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabgraph.distributed import ordered_index


def year_filter(df: DataFrame, ts: str, year: int) -> DataFrame:
    """One calendar year, written as a range so that the scan can prune on it."""
    start = F.lit(f"{year:04d}-01-01").cast(df.schema[ts].dataType)
    end = F.lit(f"{year + 1:04d}-01-01").cast(df.schema[ts].dataType)
    return df.filter((F.col(ts) >= start) & (F.col(ts) < end))


def isin_filter(df: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """Membership in a computed id set, as a semi join."""
    return df.join(ids.select(*keys), keys, "left_semi")


def not_null_filter(df: DataFrame, column: str) -> DataFrame:
    """P5."""
    return df.filter(F.col(column).isNotNull())


def label_rows(df: DataFrame, label: str, value: int) -> DataFrame:
    """Rows of one label; null labels belong to none."""
    return df.filter(F.col(label) == value)


def label_years(df: DataFrame, ts: str) -> DataFrame:
    """Every calendar year from the first to the last timestamp, one row each."""
    span = df.agg(F.year(F.min(ts)).alias("a"), F.year(F.max(ts)).alias("b"))
    return span.filter("a is not null").select(F.explode(F.sequence("a", "b")).alias("year"))


def alignment_report(a: DataFrame, b: DataFrame, index: str, key: str) -> DataFrame:
    """P10: one row with both row counts and the number of differing keys."""
    for df in (a, b):
        require_columns(df, [index, key])
    left = a.select(index, F.col(key).alias("_a"), F.lit(1).alias("_in_a"))
    right = b.select(index, F.col(key).alias("_b"), F.lit(1).alias("_in_b"))
    return left.join(right, index, "full").agg(
        F.count("_in_a").alias("rows_left"), F.count("_in_b").alias("rows_right"),
        F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("mismatches"),
    )


def assert_aligned(a: DataFrame, b: DataFrame, index: str, key: str) -> None:
    """P10: raise unless both tables hold the same key at every row index."""
    report = alignment_report(a, b, index, key).first()
    if report.rows_left != report.rows_right:
        raise ValueError(f"row counts differ: {report.rows_left} and {report.rows_right}")
    if report.mismatches:
        raise ValueError(f"{report.mismatches} rows hold different values of {key!r}")


def require_columns(df: DataFrame, columns: list[str], not_empty: bool = False) -> DataFrame:
    """Raise on missing columns, and on an empty table if asked."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; available {df.columns}")
    if not_empty and df.isEmpty():
        raise ValueError("the table is empty")
    return df


def require_ratios(train: float, val: float) -> None:
    """Split ratios must be non-negative and sum to at most one."""
    if train < 0 or val < 0 or train + val > 1:
        raise ValueError(f"bad split ratios {train}, {val}")


def top_k_per_year(facts: DataFrame, key: str, ts: str, k: int) -> DataFrame:
    """The ``k`` most frequent keys of each calendar year; ties go to the smaller key.

    Counts combine map-side; the rank filter is a group limit, applied in every
    task before the shuffle by year.
    """
    counts = facts.groupBy(F.year(ts).alias("year"), key).agg(F.count(F.lit(1)).alias("count"))
    best = Window.partitionBy("year").orderBy(F.desc("count"), F.asc(key))
    ranked = counts.withColumn("rank", F.row_number().over(best).cast("long"))
    return ranked.filter(F.col("rank") <= k)


def latest_n(train: DataFrame, n: int, ts: str, keys: list[str], name: str = "node_id") -> DataFrame:
    """The last ``n`` rows by time, re-indexed 0..n-1 in ascending order."""
    order = [F.desc(ts), *[F.desc(k) for k in keys]]
    kept = train.drop(name).orderBy(*order).limit(n)
    return ordered_index(kept, [ts, *keys], name)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Concatenation by column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def without_nan(column: Column | str) -> Column:
    """NaN as null, so that extremes skip it."""
    column = F.col(column) if isinstance(column, str) else column
    return F.nanvl(column.cast("double"), F.lit(None).cast("double"))


def global_range(df: DataFrame, column: str) -> DataFrame:
    """One row with the smallest and largest value, NaN and null skipped."""
    clean = without_nan(column)
    return df.agg(F.min(clean).alias("lo"), F.max(clean).alias("hi"))


def distinct_labels(df: DataFrame, label: str) -> DataFrame:
    """A13."""
    return df.select(label).filter(F.col(label).isNotNull()).distinct()


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, std, extremes and exact quartiles, one row per column."""
    stats = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(c).alias("count"),
            F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"),
            F.min(c).cast("double").alias("min"),
            F.percentile(c, F.lit(0.25)).alias("q25"),
            F.percentile(c, F.lit(0.5)).alias("q50"),
            F.percentile(c, F.lit(0.75)).alias("q75"),
            F.max(c).cast("double").alias("max"),
        )
        for c in columns
    ]
    return df.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def count_statistics(df: DataFrame, column: str) -> DataFrame:
    """Size, extremes and mean of a count column."""
    return df.agg(
        F.count(F.lit(1)).alias("n_nodes"), F.min(column).alias("min_count"),
        F.max(column).alias("max_count"), F.avg(column).alias("mean_count"),
    )


def is_list(df: DataFrame, column: str) -> bool:
    """Whether a column holds list cells, read off the schema."""
    return isinstance(df.schema[column].dataType, T.ArrayType)
