"""Physical plans: no cross products, filters and columns reach the scans."""

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from tabgraph.catalog import similarities as cat
from tabgraph.operators import joins, rows
from tabgraph.operators import similarity as S
from tabgraph.plans.features import customer_features
from tabgraph.sources import adapters as src


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("build", [
    lambda s: S.sim_count(cat.customer_counts(s, SF_DIR), "n_orders", 0.3).pairs,
    lambda s: S.sim_distribution_items(cat.customers_only(s, SF_DIR), cat.price_items(s, SF_DIR), 0.8).pairs,
    lambda s: S.sim_exact(cat.customer_counts(s, SF_DIR), "segment").pairs,
    lambda s: S.sim_overlap_items(cat.orders_with_items(s, SF_DIR), cat.order_items(s, SF_DIR), min_sim=0.3).pairs,
    lambda s: S.sim_numeric(cat.customer_counts(s, SF_DIR), "acctbal", 0.999).pairs,
    lambda s: S.sim_cosine(cat.vectors(s, SF_DIR), "embedding", 0.3).pairs,
    lambda s: customer_features(src.train(s, SF_DIR), src.fact(s, SF_DIR), src.product(s, SF_DIR)),
])
def test_no_cross_products(spark, build):
    text = plan(build(spark))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_year_filter_is_pushed_down(spark):
    orders = src.table(spark, SF_DIR, "orders").select("o_orderkey", "o_orderdate")
    text = plan(rows.year_filter(orders, "o_orderdate", 1997))
    assert "GreaterThanOrEqual(o_orderdate" in text and "o_totalprice" not in text


def test_feature_frame_reads_needed_columns_only(spark):
    text = plan(customer_features(src.train(spark, SF_DIR), src.fact(spark, SF_DIR), src.product(spark, SF_DIR)))
    for unused in ("l_extendedprice", "o_totalprice", "c_acctbal", "p_size"):
        assert unused not in text


def test_window_join_carries_a_time_slot(spark):
    facts = src.fact(spark, SF_DIR).select("customer_id", "review_time")
    text = plan(joins.window_join(src.train(spark, SF_DIR), facts, "customer_id", "timestamp", "review_time", "-6mo"))
    assert "_slot" in text


def test_yearly_top_k_limits_before_the_shuffle(spark):
    facts = src.fact(spark, SF_DIR)
    text = plan(rows.top_k_per_year(facts, "product_id", "review_time", 5).select(F.col("year")))
    assert "WindowGroupLimit" in text


def _few_that_become_many(spark):
    """Rows whose repetition the planner does not see, and many facts of an unknown number."""
    train = spark.range(200).select(F.col("id").alias("k"), F.explode(src.snapshots()).alias("ts"))
    facts = spark.range(10**9).select((F.col("id") % 200).alias("k"), F.lit("1999-05-01").cast("timestamp_ntz").alias("at"))
    return train, facts


def test_window_join_never_broadcasts_repeated_rows(spark):
    train, facts = _few_that_become_many(spark)
    text = plan(joins.window_join(train, facts, "k", "ts", "at", "-6mo"))
    assert "BroadcastHashJoin" not in text and "SortMergeJoin" in text


def test_window_exists_never_broadcasts_repeated_rows(spark):
    train, facts = _few_that_become_many(spark)
    text = plan(joins.window_exists(train, facts, ["k"], "ts", "at", "-6mo"))
    assert "BroadcastHashJoin" not in text and "BroadcastNestedLoopJoin" not in text


def test_overlaps_of_small_bags_look_up_no_bag(spark):
    """What two bags share comes from the hits; a row per candidate never carries whole bags."""
    found = S.sim_overlap_items(cat.orders_with_items(spark, SF_DIR), cat.order_items(spark, SF_DIR))
    assert "entries_a" not in found.pairs._jdf.queryExecution().optimizedPlan().toString()
