"""Headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import statistics
import time

from pyspark.sql import functions as F

from tabgraph.distributed import materialize
from tabgraph.operators import graph as G
from tabgraph.operators import lists, propagate, sampling
from tabgraph.operators import similarity as S
from tabgraph.plans.features import customer_features
from tabgraph.plans.sampler import draw_samples
from tabgraph.session import local_session
from tabgraph.sources import adapters as src

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def rows_of(df) -> int:
    """Compute every column of every row, and count the rows."""
    observed = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns) % 2)).first()
    return observed[0]


def b1_feature_frame(spark):
    return rows_of(customer_features(
        src.train(spark, SF_DIR), src.fact(spark, SF_DIR), src.product(spark, SF_DIR)))


def b2_sampler(spark):
    return rows_of(draw_samples(
        src.train(spark, SF_DIR), src.fact(spark, SF_DIR), top_k=1000, time_window="6mo",
        sample_size=5000, n_files=3, churn_ratio=0.6))


def b3_column_expansion(spark):
    cells = lists.key_lists(
        src.train(spark, SF_DIR, with_id=True), src.fact(spark, SF_DIR), "customer_id", "product_id",
        "timestamp", "review_time", "-6mo", ["review_time", "product_id"])
    return rows_of(lists.expand_columns(
        cells, src.product(spark, SF_DIR), "product_id",
        ["title", "brand", "price", "category"], "product"))


def _order_counts(spark):
    orders = src.table(spark, SF_DIR, "orders").groupBy(F.col("o_custkey").alias("node_id")).agg(
        F.count(F.lit(1)).alias("n_orders"))
    customers = src.table(spark, SF_DIR, "customer").select(
        F.col("c_custkey").alias("node_id"), F.col("c_acctbal").alias("acctbal"),
        (F.col("c_nationkey") % 2).alias("y"))
    return customers.join(orders, "node_id", "left").fillna(0, ["n_orders"])


def b4_count_similarity(spark):
    nodes = _order_counts(spark)
    graph = G.Graph.above(S.sim_count(nodes, "n_orders", 0.4), 0.4)
    return int(G.density(graph).first().n_edges)


def b5_overlap_similarity(spark):
    items = lists.window_items(
        src.train(spark, SF_DIR, with_id=True), src.fact(spark, SF_DIR), "customer_id",
        ["product_id"], "timestamp", "review_time", "-6mo")
    items = materialize(items)  # read three times below
    nodes = materialize(sampling.sample_n(items.select("node_id").distinct(), 5000, ["node_id"]))
    kept = items.join(nodes.select("node_id"), "node_id", "left_semi")
    return rows_of(S.sim_overlap_items(
        nodes, kept.withColumnRenamed("product_id", "item"), min_sim=0.1).pairs)


def b6_cosine_threshold(spark):
    nodes = src.table(spark, SF_DIR, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding")
    histogram = S.cosine_histogram(nodes, "embedding", G.SCALE)
    n = nodes.count()
    threshold = G.threshold_for_density(histogram, n, 5.0)
    return rows_of(S.sim_cosine(nodes, "embedding", threshold).pairs)


def b7_graph_metrics(spark):
    nodes = materialize(_order_counts(spark))
    graph = G.Graph.above(S.sim_count(nodes, "n_orders", 0.4), 0.4)
    rows = rows_of(G.graph_summary(graph, nodes))
    return rows + rows_of(propagate.propagate_gcn(graph, nodes, ["acctbal"], 2))


JOBS = [b1_feature_frame, b2_sampler, b3_column_expansion, b4_count_similarity,
        b5_overlap_similarity, b6_cosine_threshold, b7_graph_metrics]


def main() -> None:
    spark = local_session()
    medians, cold, rows = {}, {}, {}
    for job in JOBS:
        times = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            rows[job.__name__] = job(spark)
            times.append(time.perf_counter() - start)
        cold[job.__name__] = round(times[0], 3)
        medians[job.__name__] = round(statistics.median(times[1:]), 3)
    print(json.dumps({
        "metric": "total of warm medians", "value": round(sum(medians.values()), 3), "unit": "sec",
        "queries": medians, "cold": cold, "rows": rows, "sf": os.path.basename(SF_DIR.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
