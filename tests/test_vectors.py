"""Graphs and node pairs from blocks of vectors, without a table of pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabgraph.operators import graph as G, propagate
from tabgraph.operators import similarity as S
from tabgraph.plans import experiment


def vectors(spark, n=60, copies=150):
    """Random vectors, one held by many nodes, a zero vector and a missing one."""
    draw = np.random.default_rng(3)
    rows = [(i, [float(x) for x in draw.normal(size=4)]) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(copies)] + [(5000, [0.0] * 4), (5001, None)]
    return rows, spark.createDataFrame(rows, "node_id long, v array<double>")


def linked(rows, t):
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and any(v)}
    return {(i, j): float(unit[i] @ unit[j]) for i in unit for j in unit if i < j and unit[i] @ unit[j] > t}


@pytest.mark.parametrize("axes, block", [((), 16), ((), 10_000), ((0, 2), 16)])
def test_node_pairs_are_written_where_they_are_found(spark, axes, block):
    rows, nodes = vectors(spark)
    found = S.sim_cosine(nodes, "v", 0.3, grid_axes=list(axes), block=block).between_nodes()
    # No pair is joined with the members of its classes.
    assert found._jdf.queryExecution().optimizedPlan().toString().startswith("MapInArrow")
    got, want = found.collect(), linked(rows, 0.3)
    assert len(got) == len(want) and {(r.src, r.dst) for r in got} == set(want)
    assert all(abs(r.sim - want[r.src, r.dst]) < 1e-9 for r in got)


@pytest.mark.parametrize("block", [16, 10_000])
def test_bucketed_pairs_meet_in_blocks(spark, block):
    """Each pair above the similarity that shares a bucket in some table, once; no candidate is a row."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    rows, nodes = vectors(spark, copies=3)
    unit = [(i, [float(x) for x in np.array(v) / np.linalg.norm(v)]) for i, v in rows if v and any(v)]
    held = spark.createDataFrame(unit, "i long, u array<double>").withColumn("v", array_to_vector("u"))
    lsh = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=0.5, numHashTables=2, seed=17)
    hashes = {r.i: [v[0] for v in r.h] for r in lsh.fit(held).transform(held).collect()}
    every = linked(rows, 0.3)
    want = {p: s for p, s in every.items() if any(x == y for x, y in zip(hashes[p[0]], hashes[p[1]]))}
    found = S.sim_cosine_lsh(nodes, "v", 0.3, tables=2, block=block)
    got = found.between_nodes().collect()
    assert 0 < len(want) < len(every)
    assert len(got) == len(want) and {(r.src, r.dst) for r in got} == set(want)
    assert all(abs(r.sim - want[r.src, r.dst]) < 1e-9 for r in got)


def test_repeated_and_missing_ids_pair_as_before(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [1.0, 0.1]), (3, [1.0, 0.1])]
    near = S.sim_cosine(spark.createDataFrame(rows, "node_id long, v array<double>"), "v", 0.5)
    plain = S.expand_pairs(near.members, near.pairs)
    key = lambda df: sorted((r.src, r.dst, round(r.sim, 9)) for r in df.collect())
    assert key(near.between_nodes()) == key(plain)


@pytest.mark.parametrize("block", [16, 10_000])
def test_vector_graph_equals_its_edge_list(spark, block):
    rows, nodes = vectors(spark)
    near = S.sim_cosine(nodes, "v", 0.2, block=block)
    graph = G.Graph.above(near, 0.4)
    assert isinstance(graph, G.CosineGraph)
    plain = G.Graph.from_edges(nodes, G.symmetric(spark.createDataFrame(list(linked(rows, 0.4)), "src long, dst long")))
    labels = nodes.select("node_id", F.when(F.col("node_id") % 3 > 0, (F.col("node_id") % 3).cast("string")).alias("y"))
    x = nodes.select("node_id", F.when(F.col("node_id") == 7, math.inf).when(F.col("node_id") == 8, None).otherwise(
        F.col("node_id") / 7).alias("x"), (F.col("node_id") * 2.0).alias("z"))
    for of in (G.degree, lambda g: G.mixing_counts(g, labels.filter("y is not null")), G.density,
               lambda g: propagate.propagate_gin(g, x, ["x", "z"]), lambda g: propagate.propagate_sage(g, x, ["z"], 1, "max").filter("node_id <> 5001")):
        got, want = (sorted((tuple(r) for r in of(g).collect()), key=str) for g in (graph, plain))
        assert len(got) == len(want)
        for a, b in zip(got, want):
            assert a == pytest.approx(b, nan_ok=True)


def test_graph_of_a_density_stores_no_pairs(spark, monkeypatch):
    rows, nodes = vectors(spark, 80, 5)
    near = S.sim_cosine(nodes, "v", 0.0)
    expected = G.threshold_for_density(G.similarity_histogram(near.with_pairs(near.pairs)), 87, 20.0)
    monkeypatch.setattr(S, "_emit_pairs", None)  # pairs would be made here
    near = S.Similarity(near.members, near.pairs, "dense", 0.0, None, near.vectors)
    _, graph, threshold = experiment.build_graph(nodes.withColumn("y", F.lit(1)), near, 20.0)
    assert threshold == expected
    assert G.edge_count(graph).first().n_edges == len(linked(rows, threshold))


def test_normalized_node_pairs_are_written_where_they_are_found(spark):
    """G1 of vectors: the extremes leave a block as numbers, and no pair is shuffled."""
    rows, nodes = vectors(spark, copies=5)
    near = S.sim_cosine(nodes, "v", -1.0, block=16)
    scaled = G.normalize_pairs(near)
    found = scaled.between_nodes()
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    got, want = {(r.src, r.dst): r.sim for r in found.collect()}, linked(rows, -1.0)
    low = min(want.values())
    assert got.keys() == want.keys()
    assert all(abs(got[p] - (s - low) / (1 - low)) < 1e-9 for p, s in want.items())
    edges = {(r.src, r.dst) for r in G.build_edges(scaled, 0.5).collect()}
    assert edges == {e for p, s in got.items() if s > 0.5 for e in (p, p[::-1])}
    key = lambda df: sorted((r.src, r.dst, round(r.sim, 9)) for r in df.collect())
    assert key(found) == key(S.expand_pairs(scaled.members, scaled.pairs))


def test_normalizing_vectors_without_pairs_changes_nothing(spark):
    """One node, no pair: nothing to scale."""
    near = S.sim_cosine(spark.createDataFrame([(1, [1.0, 0.0])], "node_id long, v array<double>"), "v", -1.0)
    assert G.normalize_pairs(near).between_nodes().collect() == []


def test_plan_of_a_grid_does_not_hold_its_offsets_as_expressions(spark):
    """Four axes have 41 offsets; an expression for each took the driver's memory."""
    nodes = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (2, [1.0, 0.01, 0.0, 0.0])], "node_id long, v array<double>")
    found = S.sim_cosine(nodes, "v", 0.99, grid_axes=[0, 1, 2, 3]).between_nodes()
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("concat_ws") < 8
    assert [(r.src, r.dst) for r in found.collect()] == [(1, 2)]


@pytest.mark.parametrize("min_sim", [0.4, 0.7])
def test_node_pairs_of_numbers_and_lists_are_written_where_they_are_found(spark, min_sim, monkeypatch):
    """No pair is joined with the members of its classes; repeated and missing ids and values pair as before."""
    monkeypatch.setattr(S, "_PART", 3)
    monkeypatch.setattr(S, "_BAG_PART", 3)
    draw = np.random.default_rng(5)
    numbers = [None, float("nan"), -0.0, 0.0, *[float(x) for x in draw.normal(scale=3, size=40).round(1)], *[1.5] * 9]
    rows = [(None if i == 20 else min(i, 50), x, [float(v) for v in draw.integers(0, 4, size=i % 4)]) for i, x in enumerate(numbers)]
    nodes = spark.createDataFrame(rows, "node_id long, x double, l array<double>")
    key = lambda df: sorted((r.src, r.dst, round(r.sim, 9)) for r in df.collect())
    items = nodes.filter("node_id is not null").dropDuplicates(["node_id"])
    for near in (S.sim_count(nodes, "x", min_sim), S.sim_distribution(nodes, "l", min_sim),
                 S.sim_distribution(items, "l", min_sim)):
        found = near.between_nodes()
        # Beside the pairs inside classes no join stands above the lists that write pairs.
        across = found._jdf.queryExecution().optimizedPlan().toString().split("Generate explode(ids_b")[1]
        assert "Join" not in across.split("Generate explode(ids_a")[0]
        want = key(S.expand_pairs(near.members, near.pairs))
        assert want and key(found) == want


@pytest.mark.parametrize("block", [16, 10_000])
def test_bucketed_node_pairs_are_written_where_they_are_found(spark, block, monkeypatch):
    monkeypatch.setattr(S, "_PART", 3)
    rows, _ = vectors(spark, copies=8)
    rows += [(None, rows[1][1]), (7, rows[1][1]), (7, rows[1][1])]
    near = S.sim_cosine_lsh(spark.createDataFrame(rows, "node_id long, v array<double>"), "v", 0.3, tables=2, block=block)
    found = near.between_nodes()
    key = lambda df: sorted(((r.src, r.dst, round(r.sim, 9)) for r in df.collect()), key=str)
    want = key(S.expand_pairs(near.members, near.pairs))
    assert want and key(found) == want
    # Above the blocks that write pairs stands no join.
    top = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert any(line.startswith("+- MapInArrow") for line in top)
