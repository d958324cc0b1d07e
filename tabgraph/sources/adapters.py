"""The driver's tables in the shapes the operators expect: fact, dimension, training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabgraph.distributed import ordered_index

#: Half-yearly snapshots 1996-01-01 ... 2001-01-01 at which training rows are taken.
SNAPSHOTS = ("1996-01-01", "2001-01-01", 6)
#: A customer without an order in this many months after a snapshot has churned.
LABEL_MONTHS = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fact(spark: SparkSession, sf_dir: str, with_id: bool = False) -> DataFrame:
    """Reviews: one per lineitem, timed by its order. ``with_id`` adds a dense review_id."""
    items = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    if with_id:
        items = ordered_index(items, [
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
            "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
            "l_shipdate",
        ], "review_id")
    columns = [
        F.col("o_custkey").alias("customer_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("o_orderdate").alias("review_time"),
        F.col("l_quantity").alias("rating"),
        (F.col("l_returnflag") == "R").alias("verified"),
    ]
    if with_id:
        columns.insert(0, F.col("review_id"))
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(*columns)


def product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products; ``category`` is one value, ``category_tree`` the nested list form."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("price"),
        F.col("p_type").alias("category"),
        F.array(
            F.array(F.lit("Books"), F.col("p_type")), F.split("p_name", " ")
        ).alias("category_tree"),
    )


def snapshots():
    """Array column of the training snapshots."""
    first, last, months = SNAPSHOTS
    return F.sequence(
        F.lit(first).cast("timestamp_ntz"),
        F.lit(last).cast("timestamp_ntz"),
        F.make_interval(months=F.lit(months)),
    )


def train(spark: SparkSession, sf_dir: str, with_id: bool = False) -> DataFrame:
    """Training rows (timestamp, customer_id, churn); ``with_id`` adds a dense node_id."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"))
    rows = customers.withColumn("timestamp", F.explode(snapshots()))
    # Label windows are shorter than the snapshot step, so an order lies in at most one.
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    inside = F.filter(
        snapshots(),
        lambda s: (s <= F.col("o_orderdate"))
        & (F.col("o_orderdate") < s + F.make_interval(months=F.lit(LABEL_MONTHS))),
    )
    active = orders.select(
        F.col("o_custkey").alias("customer_id"), F.explode(inside).alias("timestamp")
    ).distinct().withColumn("_active", F.lit(True))
    labelled = rows.join(active, ["customer_id", "timestamp"], "left").select(
        "timestamp", "customer_id", F.when(F.col("_active"), 0).otherwise(1).alias("churn")
    )
    return ordered_index(labelled, ["timestamp", "customer_id"]) if with_id else labelled
