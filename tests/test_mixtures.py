"""Mixtures of pruned similarities, interval graphs and the segmented scan against brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabgraph import distributed
from tabgraph.operators import graph as G
from tabgraph.operators import joins, mixtures, propagate
from tabgraph.operators import similarity as S


# --- levels -----------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 1), st.floats(0, 0.6), st.booleans()), min_size=1, max_size=5), st.floats(0.05, 0.95))
def test_levels_spend_no_more_than_the_threshold(columns, t):
    total = sum(w for w, _, _ in columns)
    weights = {str(i): w / total for i, (w, _, _) in enumerate(columns)}
    floors = {str(i): f for i, (_, f, _) in enumerate(columns)}
    free = {str(i) for i, (_, _, x) in enumerate(columns) if x}
    if sum(weights[k] * floors[k] for k in weights) > t:
        with pytest.raises(ValueError):
            mixtures.levels(weights, floors, free, t)
        return
    got = mixtures.levels(weights, floors, free, t)
    assert set(got) == set(weights) and all(floors[k] - 1e-12 <= got[k] <= 1 + 1e-12 for k in got)
    spent = sum(weights[k] * got[k] for k in got)
    assert spent <= t + 1e-9
    # What rises, rises together as far as it can: the sum is used up unless all are at 1.
    assert spent >= t - 1e-9 or all(got[k] >= 1 - 1e-9 for k in got)


# --- mixtures ---------------------------------------------------------------


def earth_mover(a, b):
    if not a or not b:
        return float(not a and not b)
    xs = sorted(a + b)
    area = sum(abs(sum(x <= p for x in a) / len(a) - sum(x <= p for x in b) / len(b)) * (q - p) for p, q in zip(xs, xs[1:]))
    return 1 / (1 + area)


@pytest.mark.parametrize("t", [0.55, 0.8])
def test_pruned_families_mix_like_whole_ones(spark, t):
    rng = random.Random(int(t * 100))
    n = 60
    rows = [(i, rng.choice([0, 0, 0, *range(12)]), rng.choice("xyz"), [rng.gauss(0, 1) for _ in range(3)] if i % 9 else [0.0] * 3,
             [rng.choice([1.0, 2.0, 5.0]) for _ in range(rng.randint(0, 3))]) for i in range(n)]
    rows += [(n, *rows[3][1:]), (n + 1, *rows[3][1:])]  # a joint class of three
    nodes = spark.createDataFrame(rows, "node_id long, c int, s string, e array<double>, l array<double>")
    parts = {"c": S.sim_count(nodes, "c", 0.3), "s": S.sim_exact(nodes, "s"), "e": S.sim_cosine(nodes, "e", 0.4), "l": S.sim_distribution(nodes, "l", 0.4)}
    configs = [*G.mixture_configs(list(parts), random=False), *G.mixture_configs(list(parts), n_random=2, seed=4)]

    def sims(a, b):
        x, y = np.array(a[3]), np.array(b[3])
        length = np.linalg.norm(x) * np.linalg.norm(y)
        return {"c": 1 / (1 + abs(a[1] - b[1])), "s": float(a[2] == b[2]), "e": float(x @ y / length) if length else 0.0, "l": earth_mover(a[4], b[4])}

    whole = {(a[0], b[0]): sims(a, b) for i, a in enumerate(rows) for b in rows[i + 1:]}
    for config in configs:
        # A node without a direction is similar to nothing, its copies included.
        want = {k: sum(config[n] * v for n, v in s.items()) for k, s in whole.items()}
        want = {k: v for k, v in want.items() if v > t}
        got = {(r.src, r.dst): r.sim for r in G.combine_pairs(parts, [config], t)[config["type"]].between_nodes().collect()} \
            if config["type"] in ("balanced", "random_0") else None
        if got is not None:
            assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got), config
    members, table = mixtures.mixed_table(parts, configs, t)
    counts = {r.config: r.n for r in S.expand_pairs(members, table).groupBy("config").agg(F.count(F.lit(1)).alias("n")).collect()}
    for config in configs:
        assert counts.get(config["type"], 0) == sum(sum(config[n] * v for n, v in s.items()) > t for s in whole.values()), config


def test_mixtures_refuse_what_they_cannot_settle(spark):
    nodes = spark.createDataFrame([(0, 1, 2), (1, 2, 3)], "node_id long, a int, b int")
    parts = {"a": S.sim_count(nodes, "a", 0.6), "b": S.sim_count(nodes, "b", 0.6)}
    half = [{"a": 0.5, "b": 0.5, "type": "half"}]
    with pytest.raises(ValueError):
        G.combine_pairs(parts, half, 0.5)
    with pytest.raises(ValueError):
        G.combine_pairs(parts, half, 0.0)
    with pytest.raises(ValueError):
        G.combine_pairs(parts, [{"a": 0.9, "b": 0.9, "type": "much"}], 0.7)


def test_a_hot_category_proposes_nothing_it_need_not(spark):
    """Equality with a weight below the threshold is looked up, not listed: its clique makes no pairs."""
    nodes = spark.range(400).select(F.col("id").alias("node_id"), F.lit("x").alias("s"), (F.col("id") * 10).cast("int").alias("c"))
    level = mixtures.levels({"s": 0.3, "c": 0.7}, {"s": 0.0, "c": 0.2}, {"s"}, 0.6)
    assert level["s"] == 1.0 and abs(0.3 + 0.7 * level["c"] - 0.6) < 1e-9
    parts = {"s": S.sim_exact(nodes, "s"), "c": S.sim_count(nodes, "c", 0.2)}
    _, scored = mixtures.scored_pairs(parts, [{"s": 0.3, "c": 0.7}], 0.6)
    assert scored.count() == 0


# --- interval graphs --------------------------------------------------------


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(11)
    rows = [(i, rng.choice([None, float("nan"), 1.0, 1.0, 1.0, 2.0, 2.5, 3.7, 9.0, rng.random() * 10]), rng.choice("abc"), rng.random()) for i in range(150)]
    return spark.createDataFrame(rows, "node_id long, v double, y string, x double")


def listed(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("t", [0.15, 0.5, 0.9])
def test_interval_graph_equals_its_links(numbers, t):
    ranges, links = G.IntervalGraph.above(numbers, "v", t), G.Graph.above(S.sim_count(numbers, "v", t), t)
    assert listed(G.degree(ranges)) == listed(G.degree(links))
    assert listed(G.density(ranges)) == listed(G.density(links))
    assert listed(G.mixing_counts(ranges, numbers)) == listed(G.mixing_counts(links, numbers))
    for step in (lambda g: propagate.propagate_gcn(g, numbers, ["x"], 2), lambda g: propagate.propagate_gin(g, numbers, ["x"], 1),
                 lambda g: propagate.propagate_sage(g, numbers, ["x"], 2, "mean")):
        assert np.allclose(np.array(listed(step(ranges)), float), np.array(listed(step(links)), float))


def test_interval_graph_at_its_ends(numbers):
    valued = numbers.filter("v is not null and not isnan(v)").count()
    assert G.density(G.IntervalGraph.above(numbers, "v", 0.0)).first().n_edges == valued * (valued - 1) // 2
    assert G.density(G.IntervalGraph.above(numbers, "v", 1.0)).first().n_edges == 0
    assert listed(G.mixing_counts(G.IntervalGraph.above(numbers, "v", 1.0), numbers)) == []
    nothing = numbers.limit(0)
    assert G.density(G.IntervalGraph.above(nothing, "v", 0.5)).first().n_edges == 0


def test_thresholds_skip_what_has_no_number(spark):
    rows = [(1.0,), (None,), (None,), (None,), (float("nan"),), (float("nan"),)]
    values = spark.createDataFrame(rows, "v double")
    assert G.pairs_above(values, "v", [0.5, 0.0]) == [0, 0]
    assert G.pairs_above(values.unionByName(values), "v", [0.5]) == [1]
    assert G.pairs_above(values.filter("v is null"), "v", [0.5]) == [0]
    assert G.threshold_for_density_numeric(values.limit(1), "v", 5.0) == 0.0


# --- segmented scan ---------------------------------------------------------


@pytest.fixture()
def many_slices(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_last_known_of_a_key_that_fills_slices(spark, many_slices):
    """One key holds half of all rows in one instant, with few values, far apart."""
    rng = random.Random(3)
    rows = [(1, 5, i, i if i in (0, 700) else None) for i in range(1500)]
    rows += [(rng.randint(2, 40), rng.randint(0, 9), 10_000 + i, i if rng.random() < 0.3 else None) for i in range(1500)]
    frame = spark.createDataFrame(rows, "k int, t int, i int, v int").repartition(7)
    got = distributed.last_known(frame, ["k"], ["t", "i"], "v", "last")
    placed = distributed._range_placed(frame, ["k", "t", "i"])
    assert placed.filter("k = 1").select("_slice").distinct().count() > 2
    want, held = {}, {}
    for k, t, i, v in sorted(rows, key=lambda r: r[:3]):
        held[k] = v if v is not None else held.get(k)
        want[i] = held[k]
    assert {r.i: r["last"] for r in got.collect()} == want and got.columns == ["k", "t", "i", "v", "last"]


def test_asof_of_a_hot_instant_and_null_keys(spark, many_slices):
    facts = spark.createDataFrame([(1, 5, i) for i in range(2000)] + [(2, 1, 7), (None, 1, 8), (2, None, 9)], "k int, d int, id int")
    rows = spark.createDataFrame([(1, 4, 0), (1, 5, 1), (1, 9, 2), (2, 1, 3), (2, 0, 4), (None, 9, 5), (2, None, 6), (3, 9, 7)], "k int, d int, rid int")
    when = F.expr("timestamp_ntz '2020-01-01' + make_dt_interval(d)")
    got = joins.asof_join(rows.select("k", "rid", when.alias("rt")), facts.select("k", "id", when.alias("ft")), ["k"], "rt", "ft")
    assert {r.rid: r.id for r in got.collect()} == {0: None, 1: 1999, 2: 1999, 3: 7, 4: None, 5: None, 6: None, 7: None}
    assert got.columns == ["k", "rid", "rt", "ft", "id"]


@pytest.mark.parametrize("window", [None, "2h", "1d", "-3d", "2mo"])
def test_existence_in_a_window_by_slot_extremes(spark, window):
    rng = random.Random(5)
    facts = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *range(0, 24 * 90, 7)])) for _ in range(90)]
    rows = [(rng.choice([1, 2, 3, 4, None]), rng.choice([None, *range(0, 24 * 120, 5)]), i) for i in range(150)]
    when = F.expr("timestamp_ntz '2020-01-03' + make_dt_interval(0, h)")
    left = spark.createDataFrame([*rows, rows[0]], "k int, h int, i int").select("k", "i", when.alias("rt"), "h")
    right = spark.createDataFrame(facts, "k int, h int").select("k", when.alias("ft"))
    got = joins.window_exists(left, right, ["k"], "rt", "ft", window)
    from datetime import datetime, timedelta

    def low(t):
        if window is None:
            return datetime.min
        if window == "2mo":
            month = (t.month - 3) % 12 + 1
            year = t.year - (month > t.month)
            last = (datetime(year + month // 12, month % 12 + 1, 1) - timedelta(days=1)).day
            return t.replace(year=year, month=month, day=min(t.day, last))
        return t - {"2h": timedelta(hours=2), "1d": timedelta(days=1), "-3d": timedelta(days=3)}[window]

    base = datetime(2020, 1, 3)
    times = [(k, base + timedelta(hours=h)) for k, h in facts if k is not None and h is not None]
    want = sorted(i for k, h, i in [*rows, rows[0]] if k is not None and h is not None
                  for t in [base + timedelta(hours=h)] if any(x == k and low(t) <= f <= t for x, f in times))
    assert sorted(r.i for r in got.collect()) == want and got.columns == ["k", "i", "rt", "h"]
