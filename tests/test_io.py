"""Sources, sinks, registry and a whole run."""

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from tabgraph.catalog import QUERIES
from tabgraph.catalog import similarities as cat
from tabgraph.operators import graph as G, sampling
from tabgraph.operators import similarity as S
from tabgraph.plans import experiment, registry
from tabgraph.sources import tables


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a, \"b\"", ["x", None, "y z"]), (2, "c", [])], "id long, s string, l array<string>")
    tables.write_parquet(df, f"{tmp_path}/t.PARQUET")
    assert sorted(tables.read_table(spark, f"{tmp_path}/t.PARQUET").collect()) == sorted(df.collect())
    tables.write_csv(df, f"{tmp_path}/t.csv")
    back = tables.read_table(spark, f"{tmp_path}/t.csv", "id long, s string, l string")
    back = back.withColumn("l", tables.decode_list("l", "string"))
    assert sorted(back.collect()) == sorted(df.collect())


def test_preview_and_samples(spark, tmp_path):
    df = spark.range(80).withColumnRenamed("id", "node_id")
    tables.write_with_preview(df, f"{tmp_path}/p", ["node_id"])
    assert spark.read.parquet(f"{tmp_path}/p/preview").count() == 50
    assert tuple(spark.read.parquet(f"{tmp_path}/p/shape").first()) == (80, 1)
    tables.write_samples(sampling.sample_repeated(df, 10, 3, ["node_id"]), f"{tmp_path}/s")
    got = spark.read.parquet(f"{tmp_path}/s").groupBy("sample_no").count().collect()
    assert {r.sample_no: r["count"] for r in got} == {0: 10, 1: 10, 2: 10}


def test_similarity_map(spark, tmp_path):
    stored = spark.createDataFrame([("a", ["b", "c"]), ("d", None)], "key string, related array<string>")
    tables.write_parquet(stored, f"{tmp_path}/m.parquet")
    got = {tuple(r) for r in tables.read_similarity_map(spark, f"{tmp_path}/m.parquet").collect()}
    assert got == {("a", "b"), ("a", "c"), ("d", "d")}


def test_pairs_and_graph_round_trip(spark, tmp_path):
    nodes = cat.customer_counts(spark, SF_DIR).withColumn("y", (F.col("nation") % 2).cast("int"))
    similarity = S.sim_count(nodes, "n_orders", 0.2)
    tables.write_pairs(similarity, nodes.select("node_id", "y"), str(tmp_path), "n_orders")
    back = tables.read_pairs(spark, str(tmp_path), "n_orders", "dense", 0.2)
    assert back.pairs.count() == similarity.pairs.count()
    described, graph, threshold = experiment.build_graph(nodes, back, 20.0, split="rowwise")
    path = experiment.save_graph(described, back, graph, threshold, str(tmp_path), "n_orders", "degree")
    assert f"node_feature_degree/thr_{threshold:.2f}__" in path
    kept, edges, meta = tables.read_graph(spark, path)
    row = meta.first()
    assert kept.count() == row.n_nodes and edges.count() == 2 * row.n_edges
    assert abs(row.density - 20.0) < 10
    tables.append_result(meta, f"{tmp_path}/results")
    tables.append_result(meta, f"{tmp_path}/results")
    assert spark.read.parquet(f"{tmp_path}/results").count() == 2


def test_registry(spark):
    nodes = spark.createDataFrame(
        [(0, ["Visit Amazon's A Page", ""]), (1, [" A "]), (2, ["B"])], "node_id long, product_brand array<string>")
    got = registry.similarity(nodes, "categorical", "product_brand", use_rules=False)
    assert [tuple(r)[:2] for r in got.between_nodes().collect()] == [(0, 1)]
    registry.register_preprocessor("product_brand2", lambda c: F.array(F.lit("same")))
    registry.register_similarity("same", lambda nodes, column, **_: S.sim_overlap(nodes, column))
    renamed = nodes.withColumnRenamed("product_brand", "product_brand2")
    assert registry.similarity(renamed, "same", "product_brand2").between_nodes().count() == 3
    with pytest.raises(ValueError):
        registry.similarity(nodes, "nope", "product_brand")
    with pytest.raises(ValueError):
        registry.similarity(nodes, "numeric", "missing", min_sim=0.5)


def test_registry_types(spark):
    nodes = spark.createDataFrame(
        [(0, 1.0, [1.0], "a b", ["2020-01-01"]), (1, 1.5, [1.2], "a b", ["2020-01-02"]), (2, 9.0, [], "c", [])],
        "node_id long, n double, l array<double>, t string, d array<string>")
    nodes = nodes.withColumn("timestamp", F.lit("2020-02-01").cast("date"))
    features = nodes.select("node_id", F.col("node_id").alias("customer_id"), F.lit(3).alias("num_reviews"))
    wanted = nodes.withColumn("customer_id", F.col("node_id"))
    calls = [("numeric", "n", {}), ("numeric", "l", {}), ("text", "t", {}), ("date", "d", {}),
             ("review_count", "num_reviews", {"features": features})]
    for kind, column, extra in calls:
        got = registry.similarity(wanted, kind, column, min_sim=0.5, **extra)
        assert got.between_nodes().filter("src = 0 and dst = 1").count() == 1, kind


@pytest.mark.parametrize("name", ["g13_build_graph", "l7_mlp_scores", "l5_l8_l9_binary_experiment"])
def test_runs_without_oracle(spark, name):
    got = QUERIES[name](spark, SF_DIR).collect()
    assert got
    if name.startswith("l5"):
        assert {r.split for r in got} == {"train", "val", "test"}
        assert all(0 <= r[m] <= 1 for r in got for m in ("accuracy", "f1", "auroc"))


def test_gcn_learns_from_neighbours(spark):
    n = 60
    nodes = spark.createDataFrame([(i, i % 2, float(i % 2) if i % 3 else 0.5) for i in range(n)], "node_id long, y int, x double")
    same = S.sim_exact(nodes.withColumn("g", F.col("y").cast("string")), "g")
    scored, table = experiment.run_experiment(
        sampling.split_stratified(nodes, "y"), G.Graph.above(same, 0.5), ["x"], "GIN", hops=(1,), regs=(0.0,))
    assert scored.count() == n
    assert all(r.accuracy == 1.0 for r in table.collect())
    with pytest.raises(ValueError):
        experiment.run_experiment(nodes, G.Graph.above(same, 0.5), ["x"], class_weights=[1.0, 2.0])
