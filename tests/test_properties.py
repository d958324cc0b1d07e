"""Pruned joins equal brute force; results do not depend on partitions or skew."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabgraph import distributed
from tabgraph.operators import evaluate, graph as G, joins, propagate
from tabgraph.operators import similarity as S
from tabgraph.operators.text_similarity import embed_text, sim_text


def node_pairs(similarity):
    got = similarity.between_nodes().collect()
    assert len({(r.src, r.dst) for r in got}) == len(got)
    assert all(r.src < r.dst for r in got)
    return {(r.src, r.dst): r.sim for r in got}


def agree(got, want):
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def brute(n, sim, t):
    return {(i, j): sim(i, j) for i in range(n) for j in range(i + 1, n) if sim(i, j) > t}


@pytest.fixture(scope="module")
def rng():
    return random.Random(7)


@pytest.mark.parametrize("parts", [1, 37])
def test_ordered_index_is_dense_under_skew(spark, parts):
    df = spark.range(3000).select((F.col("id") % 7).alias("k"), F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("v"))
    got = distributed.ordered_index(df.repartition(parts), ["v", "k"], "i").collect()
    assert sorted(r.i for r in got) == list(range(3000))
    in_order = sorted(got, key=lambda r: r.i)
    assert [(r.v, r.k) for r in in_order] == sorted((r.v, r.k) for r in got)


def test_running_totals(spark):
    df = spark.range(500).withColumn("v", F.col("id") % 13)
    got = distributed.running_totals(df, ["id"], {"s": F.col("v")}).orderBy("id").collect()
    assert [r.s for r in got] == list(np.cumsum([i % 13 for i in range(500)]))


def test_hash_rank_and_smallest_agree(spark):
    df = spark.range(400).withColumn("g", (F.col("id") > 50).cast("int"))
    digest = distributed.seeded_hash(1, "id")
    ranked = distributed.hash_rank(df, digest, ["id"], "r", ["g"]).filter("r < 20")
    drawn = distributed.hash_smallest(df, digest, ["id"], 20, ["g"])
    assert {(r.id, r.r) for r in ranked.collect()} == {(r.id, r.draw_no) for r in drawn.collect()}


def test_hot_entity_window_and_asof(spark, rng):
    facts = [(1 if rng.random() < .4 else rng.randint(2, 9), rng.randint(0, 400), i) for i in range(600)]
    rows = [(rng.randint(1, 9), rng.randint(0, 400), i) for i in range(80)]
    f = spark.createDataFrame(facts, "k int, d int, id int").select(
        "k", "id", F.expr("timestamp_ntz '2020-01-01' + make_dt_interval(d)").alias("ft"), "d")
    r = spark.createDataFrame(rows, "k int, d int, rid int").select(
        "k", "rid", F.expr("timestamp_ntz '2020-01-01' + make_dt_interval(d)").alias("rt"))
    for width in (1, 7, 500):
        got = joins.window_join(r, f, "k", "rt", "ft", "-30d", bucket_days=width).collect()
        want = {(b[2], a[2]) for a in facts for b in rows if a[0] == b[0] and b[1] - 30 <= a[1] < b[1]}
        assert {(x.rid, x.id) for x in got} == want and len(got) == len(want)
        near = joins.asof_join(r, f, ["k"], "rt", "ft").collect()
        for x in near:
            row = next(b for b in rows if b[2] == x.rid)
            days = [a[1] for a in facts if a[0] == row[0] and a[1] <= row[1]]
            assert x.d == (max(days) if days else None)
        assert len(near) == len(rows)


@pytest.mark.parametrize("t", [0.2, 0.5, 0.9])
def test_count_pairs(spark, rng, t):
    vals = [0 if rng.random() < .35 else rng.randint(0, 30) for _ in range(60)]
    nodes = spark.createDataFrame(list(enumerate(vals)), "node_id long, n int")
    agree(node_pairs(S.sim_count(nodes, "n", t)), brute(60, lambda i, j: 1 / (1 + abs(vals[i] - vals[j])), t))


@pytest.mark.parametrize("t", [0.3, 0.8])
def test_distribution_pairs(spark, rng, t):
    cells = [[] if rng.random() < .3 else [round(rng.random() * 3, 1) for _ in range(rng.randint(1, 9))] for _ in range(40)]

    def sim(i, j):
        a, b = sorted(cells[i]), sorted(cells[j])
        if not a or not b:
            return float(not a and not b)
        x = sorted(a + b)
        steps = zip(x, x[1:])
        gap = lambda v: abs(np.searchsorted(a, v, "right") / len(a) - np.searchsorted(b, v, "right") / len(b))
        return 1 / (1 + sum(gap(p) * (q - p) for p, q in steps))

    nodes = spark.createDataFrame(list(enumerate(cells)), "node_id long, v array<double>")
    agree(node_pairs(S.sim_distribution(nodes, "v", t)), brute(40, sim, t))


def test_few_pairs_of_bags_are_measured(spark, rng, monkeypatch):
    """Bags of one mean and unlike spread are told apart by areas; blocks give what one block gives."""
    cells = [sorted(5 + (1 + i % 40) / 8 * (rng.random() - .5) * s for _ in range(4) for s in (1, -1)) for i in range(300)]
    nodes = spark.createDataFrame(list(enumerate(cells)), "node_id long, v array<double>")
    items = nodes.select("node_id", F.explode("v").alias("item"))
    want = {(i, j) for i in range(300) for j in range(i + 1, 300)
            if 1 / (1 + sum(abs(x - y) for x, y in zip(cells[i], cells[j])) / 8) > 0.9}
    for block in (32, 4096):
        got = [(r.src, r.dst) for r in S.sim_distribution_items(nodes, items, 0.9, block=block).between_nodes().collect()]
        assert len(got) == len(want) and set(got) == want
    measured = []
    found = S._distances
    monkeypatch.setattr(S, "_distances", lambda a, b, i, j: (measured.append(len(i)), found(a, b, i, j))[1])
    entries = pa.array([[{"x": x, "n": 1} for c in cells for x in c]], pa.list_(pa.struct([("x", pa.float64()), ("n", pa.int64())])))
    batch = pa.RecordBatch.from_pydict({"home_b": [[True] * 300], **{f"{k}_{s}": v for s in "ab" for k, v in {
        "cls": [[f"{i:03}" for i in range(300)]], "m": [[1] * 300], "size": [[8] * 300], "entries": entries}.items()}})
    rows = sum(part.num_rows for part in S._emit_distributions(0.9)([batch]))
    assert rows == len(want) <= sum(measured) < 2 * len(want) < 300 * 299 / 2 / 4


@pytest.mark.parametrize("t", [0.0, 0.25, 0.5, 0.75])
@pytest.mark.parametrize("with_map", [False, True])
def test_overlap_pairs(spark, rng, t, with_map):
    cells = [["hot"] * rng.randint(0, 2) + [rng.choice("abcdefghij") for _ in range(rng.randint(0, 5))] for _ in range(50)]
    table = {"a": {"a", "b"}, "b": {"a", "b", "c"}, "hot": {"hot", "j"}} if with_map else {}

    def share(i, j):
        other = set(cells[j])
        return sum(bool(table.get(x, {x}) & other) for x in cells[i]) / len(cells[i]) if cells[i] else 0.0

    related = spark.createDataFrame([(k, v) for k, vs in table.items() for v in vs], "key string, related string") if with_map else None
    nodes = spark.createDataFrame(list(enumerate(cells)), "node_id long, v array<string>")
    agree(node_pairs(S.sim_overlap(nodes, "v", related, t)),
          brute(50, lambda i, j: (share(i, j) + share(j, i)) / 2, t))


@pytest.mark.parametrize("axes, block, t", [((), 1024, -1.0), ((), 7, 0.2), ((0, 1), 5, 0.6), ((0, 1, 2), 1024, 0.9)])
def test_cosine_pairs(spark, axes, block, t):
    gen = np.random.default_rng(3)
    x = gen.normal(size=(70, 3))
    x[10:35] = x[0]  # copies
    x[40] = 0.0
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    cos = unit @ unit.T
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node_id long, v array<double>")
    got = node_pairs(S.sim_cosine(nodes, "v", t, grid_axes=list(axes), block=block))
    want = {k: v for k, v in brute(70, lambda i, j: cos[i, j], t).items() if 40 not in k}
    agree(got, want)
    slots = S.cosine_histogram(nodes, "v", 16, block=block).collect()
    assert sum(r.n for r in slots) == 69 * 68 // 2


def test_text_pairs(spark):
    texts = ["the red fox", "the red fox", "a blue fox runs far", "the blue sea", "", "sea of blue <b>runs</b>"] * 2
    nodes = spark.createDataFrame(list(enumerate(texts)), "node_id long, t string")
    got = node_pairs(sim_text(nodes, "t", 0.2))
    docs = [t.replace("<b>", "").replace("</b>", "").split() for t in texts]
    idf = {w: np.log(13 / (sum(w in d for d in docs) + 1)) for d in docs for w in d}
    words = sorted(idf)
    m = np.array([[d.count(w) * idf[w] for w in words] for d in docs])
    m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    agree(got, brute(12, lambda i, j: float(m[i] @ m[j]), 0.2))


def skewed_similarity(spark):
    """30 nodes of one value, and some others; clique of the hot value included."""
    vals = [5] * 30 + [6] * 3 + [8, 9, 9, 20]
    nodes = spark.createDataFrame([(i, v, i % 3, float(i)) for i, v in enumerate(vals)], "node_id long, n int, y int, x double")
    return nodes, S.sim_count(nodes, "n", 0.3)


def test_factored_graph_equals_its_edge_list(spark):
    nodes, similarity = skewed_similarity(spark)
    factored = G.Graph.above(similarity, 0.4)
    edges = G.build_edges(similarity, 0.4)
    plain = G.Graph.from_edges(nodes, edges)
    assert edges.count() == edges.distinct().count() == 2 * G.density(factored).first().n_edges
    summary = [G.graph_summary(g, nodes).first() for g in (factored, plain)]
    assert summary[0] == pytest.approx(summary[1])
    rows = [sorted(map(tuple, G.degree(g).collect())) for g in (factored, plain)]
    assert rows[0] == rows[1]
    steps = [lambda g: propagate.propagate_gcn(g, nodes, ["x"], 2), lambda g: propagate.propagate_gin(g, nodes, ["x"])]
    steps += [lambda g, a=a: propagate.propagate_sage(g, nodes, ["x"], 2, a) for a in ("mean", "sum", "max")]
    for step in steps:
        a, b = [np.array(sorted(map(tuple, step(g).collect()))) for g in (factored, plain)]
        assert np.allclose(a, b)


def test_expansion_deals_big_classes(spark):
    _, similarity = skewed_similarity(spark)
    whole = {tuple(r) for r in S.expand_pairs(similarity.members, similarity.pairs).collect()}
    dealt = [tuple(r) for r in S.expand_pairs(similarity.members, similarity.pairs, rows_per_part=4).collect()]
    assert set(dealt) == whole and len(dealt) == len(whole)


def test_top_n_equals_brute_force(spark):
    nodes, similarity = skewed_similarity(spark)
    vals = [r.n for r in nodes.orderBy("node_id").collect()]
    got = {}
    for r in G.top_n_similar_all(similarity, 4).orderBy("node_id", "rank").collect():
        got.setdefault(r.node_id, []).append(r.neighbour)
    for i, v in enumerate(vals):
        near = sorted((-1 / (1 + abs(v - w)), j) for j, w in enumerate(vals) if j != i and 1 / (1 + abs(v - w)) > 0.3)
        assert got.get(i, []) == [j for _, j in near[:4]]


@pytest.mark.parametrize("target", [1.0, 7.5, 30.0, 60.0, 99.0])
def test_threshold_equals_literal_bisection(spark, rng, target):
    vals = [rng.random() for _ in range(40)]
    sims = np.array([1 / (1 + abs(a - b)) for i, a in enumerate(vals) for b in vals[i + 1:]])

    def literal():
        low, high, best, closest = 0.0, 1.0, 0.0, float("inf")
        for _ in range(100):
            mid = (low + high) / 2
            if high - low < 1e-6:
                break
            d = (sims > mid).sum() / len(sims) * 100
            if abs(d - target) < closest:
                best, closest = mid, abs(d - target)
            if closest <= 0.1:
                break
            low, high = (mid, high) if d > target else (low, mid)
        return best

    nodes = spark.createDataFrame(list(enumerate(vals)), "node_id long, v double")
    assert G.threshold_for_density_numeric(nodes, "v", target) == literal()
    histogram = G.similarity_histogram(S.sim_count(nodes, "v", 0.1))
    assert G.threshold_for_density(histogram, 40, target) == literal()


def test_pruned_search_that_ends_below_raises(spark):
    nodes = spark.createDataFrame([(i, i * 10) for i in range(10)], "node_id long, v int")
    similarity = S.sim_count(nodes, "v", 0.5)
    with pytest.raises(ValueError):
        G.threshold_for_density(G.similarity_histogram(similarity), 10, 50.0, min_sim=0.5)
    with pytest.raises(ValueError):
        G.Graph.above(similarity, 0.4)


def test_pairs_above(spark, rng):
    vals = [3.0] * 20 + [round(rng.random() * 5, 2) for _ in range(30)]
    nodes = spark.createDataFrame([(v,) for v in vals], "v double")
    thresholds = [0.0, 0.21, 0.5, 0.8, 0.999, 1.0]
    want = [sum(1 / (1 + abs(a - b)) > t for i, a in enumerate(vals) for b in vals[i + 1:]) for t in thresholds]
    assert G.pairs_above(nodes, "v", thresholds) == want


def test_combined_pairs(spark, rng):
    cols = {"a": [rng.choice("uv") for _ in range(25)], "b": [rng.choice("xyz") for _ in range(25)]}
    nodes = spark.createDataFrame(list(zip(range(25), *cols.values())), "node_id long, a string, b string")
    mixed = G.combine_pairs({k: S.sim_exact(nodes, k) for k in cols}, [{"a": .3, "b": .7, "type": "t"}], 0.2)["t"]
    agree(node_pairs(mixed), brute(25, lambda i, j: .3 * (cols["a"][i] == cols["a"][j]) + .7 * (cols["b"][i] == cols["b"][j]), 0.2))


def test_auroc_against_pair_counting(spark, rng):
    rows = [(s, int(rng.random() < .4), round(rng.random(), 1)) for s in ("train", "val") for _ in range(80)]
    scored = spark.createDataFrame(rows, "split string, y int, p double")
    for r in evaluate.auroc(scored.repartition(5)).collect():
        pos = [p for s, y, p in rows if s == r.split and y]
        neg = [p for s, y, p in rows if s == r.split and not y]
        wins = sum((a > b) + (a == b) / 2 for a in pos for b in neg)
        assert r.auroc == pytest.approx(wins / len(pos) / len(neg))


@pytest.mark.parametrize("with_map", [False, True])
def test_overlap_pairs_of_bags_with_items_that_do_not_probe(spark, rng, with_map):
    bags = {i: [str(rng.randint(0, 14)) for _ in range(rng.choice([1, 2, 9, 14]))] for i in range(30)}
    expand = {str(k): [str(k), str((k + 5) % 15)] if with_map and k % 2 else [str(k)] for k in range(15)}
    related = spark.createDataFrame([(k, v) for k, vs in expand.items() for v in vs], "key string, related string") if with_map else None

    def share(a, b):
        return sum(any(v in b for v in expand[x]) for x in a) / len(a)

    nodes = spark.createDataFrame(list(bags.items()), "node_id long, v array<string>")
    got = node_pairs(S.sim_overlap(nodes, "v", related, 0.6))
    agree(got, brute(30, lambda i, j: (share(bags[i], bags[j]) + share(bags[j], bags[i])) / 2, 0.6))


def test_large_blocks_are_multiplied_tile_by_tile():
    import numpy as np
    import pyarrow as pa

    n = 1200
    units = np.random.default_rng(5).normal(size=(n, 3))
    units /= np.linalg.norm(units, axis=1)[:, None]
    side = {"cls": [f"{i:05d}" for i in range(n)], "m": [1] * n, "home": [True] * n, "unit": units.ravel().tolist()}
    batch = pa.RecordBatch.from_pydict({
        **{f"{k}_{tag}": [v] for k, v in side.items() for tag in "ab"}, "i": [0], "j": [0]})
    tiles = list(S._grid_products([batch], True))
    assert max(sims.shape[0] for *_, sims, _ in tiles) <= 512
    assert sum(int(once.sum()) for *_, once in tiles) == n * (n - 1) // 2
    counts = {s: c for b in S._emit_counts(64, True)([batch]) for s, c in zip(b["slot"].to_pylist(), b["n"].to_pylist())}
    slots = np.clip(np.ceil((units @ units.T)[np.triu_indices(n, 1)] * 64), 0, 65).astype(int)
    assert counts == dict(zip(*(x.tolist() for x in np.unique(slots, return_counts=True))))


def test_self_pairs_compare_only_pairs_that_can_repeat(spark):
    rows = [(i, i % 3) for i in range(30)] + [(1, 2), (2, 1), (4, 0), (4, 1), (None, 1), (5, None)]
    nodes = spark.createDataFrame(rows, "id long, band int")
    got = [(r.src, r.dst) for r in joins.self_pairs(nodes, ["band"], "id").collect()]
    want = {(a, b) for a, x in rows for b, y in rows if a is not None and b is not None and x is not None and a < b and x == y}
    assert len(got) == len(want) and set(got) == want
    plan = joins.self_pairs(nodes, ["band"], "id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union")  # before: one aggregate over all pairs


def test_top_n_finishes_lists_in_their_rows(spark):
    rows = [(i, "abc"[i % 3]) for i in range(40)] + [(33, "b"), (33, "b"), (7, None), (41, None), (-5, "z")]
    nodes = spark.createDataFrame(rows, "node_id long, k string")
    found = G.top_n_similar_all(S.sim_exact(nodes, "k"), 6)
    sims = {}
    for i, x in rows:
        for j, y in rows:
            if i != j:
                sims[i, j] = max(sims.get((i, j), 0.0), float(x == y))
    want = set()
    for i in {i for i, _ in rows}:
        best = sorted((-s, j) for (k, j), s in sims.items() if k == i)[:6]
        want |= {(i, at, j, -s) for at, (s, j) in enumerate(best, 1)}
    got = [tuple(r) for r in found.select("node_id", "rank", "neighbour", "similarity").collect()]
    assert len(got) == len(want) and set(got) == want
    # before: every node's list went through an aggregate and a window of its own
    assert "windowspecdefinition(node_id#" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_cut_into_terms_where_their_node_is(spark):
    rows = [(1, "a b b c"), (1, "a d"), (2, "b c"), (3, None), (None, "c d e"), (4, "x")]
    found = embed_text(spark.createDataFrame(rows, "node_id long, text string"), "text")
    got = {(r.node_id, r.term): r.weight for r in found.collect()}
    counts, heads = {}, {}
    for i, text in rows:
        for w in (text or "").split():
            counts[i, w] = counts.get((i, w), 0) + 1
    for _, w in counts:
        heads[w] = heads.get(w, 0) + 1
    raw = {k: n * np.log(7 / (heads[k[1]] + 1)) for k, n in counts.items()}
    norm = {i: np.sqrt(sum(v * v for (j, _), v in raw.items() if j == i)) for i, _ in raw}
    agree(got, {k: v / norm[k[0]] for k, v in raw.items() if k[0] is not None})
    planned = found._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in planned.split("\n") if "Exchange hashpartitioning(node_id" in x and ", term" in x]
