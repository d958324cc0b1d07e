"""Building blocks every operator shares: lineage cuts, ranks, running totals, hot keys.

None of these uses a window without ``partitionBy`` over data that grows, so a
global rank or a global cumulative sum never runs in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Row position inside a partition, as laid out by monotonically_increasing_id.
_POSITION_BITS = 33


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so lost executors re-read files.

    The folder is the session's ``spark.checkpoint.dir``, which all executors share, or one
    under its warehouse where that is not set.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints and written tables, set on first use."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{warehouse.rstrip('/')}/_checkpoints")
    return context.getCheckpointDir()


def with_scalars(df: DataFrame, row: DataFrame) -> DataFrame:
    """Adds the columns of a one-row frame to every row, as a scalar subquery (no join)."""
    names = row.columns
    packed = row.select(F.struct(*names).alias("_one")).scalar()
    return df.withColumn("_one", packed).select(*df.columns, *[F.col(f"_one.{n}").alias(n) for n in names])


def _range_placed(df: DataFrame, order: list) -> DataFrame:
    """Rows range-partitioned and sorted by ``order``, with partition no and position.

    A random last key lets exact copies of one row spread over partitions. The
    result is checkpointed first: range bounds are sampled, and rows and
    per-partition totals must come from the same evaluation.
    """
    placed = materialize(df.orderBy(*order, F.rand(17)))
    at = F.monotonically_increasing_id()
    return placed.withColumn("_at", at).withColumn("_slice", F.shiftright("_at", _POSITION_BITS))


def ordered_index(df: DataFrame, order: list, name: str = "node_id") -> DataFrame:
    """Dense 0-based row index along ``order``, computed in parallel slices."""
    placed = _range_placed(df, order)
    # One row per range slice, i.e. at most as many rows as shuffle partitions.
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    position = F.col("_at").bitwiseAND((1 << _POSITION_BITS) - 1)
    return (
        placed.join(F.broadcast(starts), "_slice")
        .withColumn(name, F.col("_start") + position)
        .drop("_slice", "_at", "_start")
    )


def running_totals(df: DataFrame, order: list, totals: dict[str, Column]) -> DataFrame:
    """Inclusive cumulative sums along ``order``; adds one column per entry of ``totals``."""
    values = {f"_v_{name}": expr for name, expr in totals.items()}
    placed = _range_placed(df.withColumns(values), order)
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    per_slice = placed.groupBy("_slice").agg(*[F.sum(v).alias(v) for v in values])
    starts = per_slice.select(
        "_slice",
        *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_s{v}") for v in values],
    )
    inside = (
        Window.partitionBy("_slice")
        .orderBy("_at")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = placed.join(F.broadcast(starts), "_slice").withColumns(
        {name: F.sum(f"_v_{name}").over(inside) + F.col(f"_s_v_{name}") for name in totals}
    )
    return summed.drop("_slice", "_at", *values, *[f"_s{v}" for v in values])


def last_known(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the last non-null ``value`` up to each row, per ``keys``, along ``order``.

    Rows are range-partitioned over (keys, order), so a key that holds a third of all rows is cut over as
    many slices as it fills, also where its rows share one time. Inside a slice a window runs; only the
    first key of a slice may go back further, and finds its value among the last ones of the slices
    before (at most two rows a slice).
    """
    placed = _range_placed(df, [*keys, *order])
    inside = Window.partitionBy("_slice", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    key = F.struct(*keys)
    ends = placed.groupBy("_slice").agg(F.min_by(key, "_at").alias("_k0"), F.max_by(key, "_at").alias("_k1"))
    # One row per range slice.
    edge = placed.join(F.broadcast(ends), "_slice").filter((key == F.col("_k0")) | (key == F.col("_k1")))
    newest = edge.filter(F.col(value).isNotNull()).groupBy("_slice", *keys).agg(F.max_by(value, "_at").alias("_last"))
    asked = ends.select("_slice", F.col("_k0.*"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = newest.join(asked, ["_slice", *keys], "full").withColumn(
        "_carry", F.last("_last", ignorenulls=True).over(earlier)).filter(F.col("_carry").isNotNull()).select("_slice", *keys, "_carry")
    # A carry is wanted by the first key of a slice only, so this has at most two rows a slice as well.
    return placed.withColumn("_near", F.last(value, ignorenulls=True).over(inside)).join(
        F.broadcast(carried), ["_slice", *keys], "left").withColumn(name, F.coalesce("_near", "_carry")).drop(
        "_slice", "_at", "_near", "_carry")


def seeded_hash(seed, *keys) -> Column:
    """Text hash that any SQL engine reproduces: md5(seed | key | key ...)."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    parts = [seed.cast("string")]
    parts += [(k if isinstance(k, Column) else F.col(k)).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts))


def hash_smallest(df: DataFrame, digest: Column, tie: list[str], quota, by: list[str] = ()) -> DataFrame:
    """Exactly the ``quota`` rows with the smallest digests, per group ``by``.

    Hash prefixes cut each group into up to 65,536 even slices. Slices whose
    predecessors already fill the quota are dropped map-side, so about ``quota``
    rows are shuffled whatever the size of the group. ``quota`` is a number or a
    DataFrame (by..., quota). Adds ``draw_no``, 0-based in hash order.
    """
    by = list(by)
    tagged = df.withColumn("_h", digest).withColumn("_cut", F.substring("_h", 1, 4))
    sizes = tagged.groupBy(*by, "_cut").agg(F.count(F.lit(1)).alias("_n"))
    # At most 65,536 rows per group.
    before = Window.partitionBy(*by).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if isinstance(quota, DataFrame):
        starts = starts.join(quota, by) if by else with_scalars(starts, quota)
    else:
        starts = starts.withColumn("quota", F.lit(int(quota)))
    starts = starts.filter(F.col("_start") < F.col("quota")).drop("_n")
    inside = Window.partitionBy(*by, "_cut").orderBy("_h", *tie)
    return (
        tagged.join(starts, [*by, "_cut"])
        .withColumn("draw_no", F.col("_start") + F.row_number().over(inside) - 1)
        .filter(F.col("draw_no") < F.col("quota"))
        .drop("_h", "_cut", "_start", "quota")
    )


def hash_rank(df: DataFrame, digest: Column, tie: list[str], name: str, by: list[str] = ()) -> DataFrame:
    """0-based rank in digest order inside each group ``by``, for all rows.

    A group is cut by hash prefix, so one holding a third of the rows still
    ranks in many tasks.
    """
    by = list(by)
    tagged = df.withColumn("_h", digest).withColumn("_cut", F.substring("_h", 1, 4))
    sizes = tagged.groupBy(*by, "_cut").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*by, "_cut", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by, "_cut").orderBy("_h", *tie)
    return (
        tagged.join(starts, [*by, "_cut"])
        .withColumn(name, F.col("_start") + F.row_number().over(inside) - 1)
        .drop("_h", "_cut", "_start")
    )


def hot_keys(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """(keys..., n) for all keys with more than ``limit`` rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)


def split_hot(df: DataFrame, keys: list[str], spread: list, limit: int, name: str = "part") -> DataFrame:
    """Number the parts a hot key is cut into: 0 for ordinary keys, else 0..ceil(n/limit)-1.

    ``spread`` are the columns whose hash picks the part of a row. The join with the hot keys is
    left to AQE, which broadcasts them only below its size threshold.
    """
    hot = hot_keys(df, keys, limit).withColumn("_parts", F.ceil(F.col("n") / limit)).drop("n")
    part = F.pmod(F.xxhash64(*spread), F.col("_parts"))
    joined = df.join(hot, keys, "left")
    return joined.withColumn(name, F.coalesce(part, F.lit(0)).cast("long")).drop("_parts")
