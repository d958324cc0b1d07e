"""Small cases with known answers."""

import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tabgraph.functions import dates, numbers, text, timewin
from tabgraph.operators import evaluate, graph as G, joins, lists, propagate, rows, rules, sampling
from tabgraph.operators import similarity as S
from tabgraph.operators.date_similarity import sim_date
from tabgraph.plans.features import customer_features


def one(spark, column, data=((1,),), schema="x int"):
    return spark.createDataFrame(list(data), schema).select(column.alias("v")).first().v


def pairs(similarity):
    return {(r.src, r.dst): round(r.sim, 6) for r in similarity.between_nodes().collect()}


def ts(spark, value):
    return F.lit(value).cast("timestamp_ntz")


# --- time -------------------------------------------------------------------


def test_offsets(spark):
    assert timewin.parse_offset("-1y6mo") == timewin.Offset(-18, 0, 0)
    assert timewin.parse_offset("2w3d12h").days == 17
    with pytest.raises(ValueError):
        timewin.parse_offset("6 months")
    moved = one(spark, timewin.offset_by(ts(spark, "2020-08-31"), "-1y6mo"))
    assert moved == datetime(2019, 2, 28)


def test_whole_days_truncate(spark):
    days = timewin.total_days(ts(spark, "2014-01-01 00:00:00"), ts(spark, "2013-12-31 12:00:00"))
    assert one(spark, days) == 0


def frames(spark, fact_times):
    train = spark.createDataFrame([(1, 0, "2020-08-31 10:00:00")], "customer_id long, node_id long, t string")
    train = train.select("customer_id", "node_id", F.col("t").cast("timestamp_ntz").alias("timestamp"))
    facts = spark.createDataFrame([(1, i, t) for i, t in enumerate(fact_times)], "customer_id long, id long, t string")
    return train, facts.select("customer_id", "id", F.col("t").cast("timestamp_ntz").alias("review_time"))


def test_window_is_half_open(spark):
    train, facts = frames(spark, ["2020-02-29 09:59:00", "2020-02-29 10:00:00", "2020-08-31 10:00:00"])
    got = joins.window_join(train, facts, "customer_id", "timestamp", "review_time", "-6mo").collect()
    assert [r.id for r in got] == [1]


def test_asof_is_inclusive_and_carries_over_slots(spark):
    train, facts = frames(spark, ["2020-08-31 10:00:00", "2020-08-31 10:00:01"])
    got = joins.asof_join(train, facts, ["customer_id"], "timestamp", "review_time").first()
    assert got.id == 0
    train, facts = frames(spark, ["2011-01-01 00:00:00", "2021-01-01 00:00:00"])
    assert joins.asof_join(train, facts, ["customer_id"], "timestamp", "review_time").first().id == 0
    train, facts = frames(spark, ["2021-01-01 00:00:00"])
    assert joins.asof_join(train, facts, ["customer_id"], "timestamp", "review_time").first().id is None


# --- aggregates and lists ---------------------------------------------------


def test_feature_frame_edge_cases(spark):
    train, facts = frames(spark, ["2020-08-30 10:00:00"])
    train = train.withColumn("churn", F.lit(1)).drop("node_id")
    facts = facts.withColumns({"product_id": F.lit(5), "rating": F.lit(4.0), "verified": F.lit(True)})
    products = spark.createDataFrame([(9, 1.0, "b", "c")], "product_id int, price double, brand string, category string")
    got = customer_features(train.union(train), facts, products).collect()
    assert [r.num_reviews for r in got] == [2, 2]  # repeated rows inflate each other
    once = customer_features(train, facts, products, dedupe=True).first()
    assert (once.num_reviews, once.std_rating, once.num_unique_brands, once.avg_product_price) == (1, 0.0, 1, 0.0)
    none = customer_features(train, facts.filter("id > 5"), products).first()
    assert none.num_reviews == 0 and none.review_frequency == 0.0


def test_n_unique_counts_null(spark):
    from tabgraph.plans.features import n_unique

    df = spark.createDataFrame([(1,), (None,), (1,)], "x int")
    assert df.agg(n_unique("x").alias("n")).first().n == 2


def test_expand_keeps_order_nulls_and_empty(spark):
    cells = spark.createDataFrame([(0, [9, 1, 9]), (1, [])], "node_id long, k array<long>")
    dim = spark.createDataFrame([(1, 5.0)], "k long, price double")
    got = {r.node_id: r.p_price for r in lists.expand_columns(cells, dim, "k", ["price"], "p").collect()}
    assert got == {0: [None, 5.0, None], 1: [None]}


def test_long_list_keeps_its_order(spark):
    train, facts = frames(spark, [f"2020-08-{d:02d} 00:00:00" for d in range(1, 21)])
    got = lists.key_lists(train, facts, "customer_id", "id", "timestamp", "review_time", "-6mo",
                          ["review_time", "id"]).collect()
    assert [r.id for r in got] == [list(range(20))]


@pytest.mark.parametrize("size", [3, 18])
def test_rules_of_long_itemsets_are_all_splits(spark, size):
    from itertools import combinations

    from tabgraph.operators.rules import association_rules

    if size > 16:  # only the longest set and its single items: every split with a side of one item
        sets = [tuple(range(size))] + [(i,) for i in range(size)] + [tuple(j for j in range(size) if j != i) for i in range(size)]
    else:
        sets = [c for k in range(1, size + 1) for c in combinations(range(size), k)]
    table = spark.createDataFrame([([f"{i:02d}" for i in c], 1.0) for c in sets], "items array<string>, support double")
    got = association_rules(table, 0.0).filter(F.size("antecedent") + F.size("consequent") == size).count()
    assert got == (2 * size if size > 16 else 2 ** size - 2)


def test_null_labels_keep_their_rows(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i % 2) for i in range(30)], "node_id long, y int")
    got = sampling.split_stratified(rows, "y").collect()
    assert len(got) == 30 and all((r.split is None) == (r.y is None) for r in got)


# --- sampling ---------------------------------------------------------------


@pytest.mark.parametrize("ones, zeros, want", [(4, 20, (4, 6)), (20, 1, (9, 1)), (20, 20, (6, 4)), (2, 3, (2, 3))])
def test_stratified_quotas(spark, ones, zeros, want):
    df = spark.createDataFrame([(i, int(i < ones)) for i in range(ones + zeros)], "id long, churn int")
    got = sampling.sample_stratified(df, 10, 0.6, ["id"]).groupBy("churn").count().collect()
    count = {r.churn: r["count"] for r in got}
    assert (count.get(1, 0), count.get(0, 0)) == want


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(1000)
    a = {r.id for r in sampling.sample_n(df.repartition(1), 100, ["id"]).collect()}
    b = {r.id for r in sampling.sample_n(df.repartition(37), 100, ["id"]).collect()}
    assert a == b and len(a) == 100
    assert sampling.sample_n(spark.range(5), 100, ["id"]).count() == 5


@pytest.mark.parametrize("n, want", [(15, (12, 1, 2)), (10, (8, 1, 1))])
def test_rowwise_and_temporal_sizes(spark, n, want):
    nodes = spark.range(n).withColumnRenamed("id", "node_id").withColumn(
        "timestamp", F.expr("timestamp_ntz '2020-01-01'"))
    for df in (sampling.split_rowwise(nodes), sampling.split_temporal(nodes)):
        got = {r.split: r["count"] for r in df.groupBy("split").count().collect()}
        assert tuple(got.get(s, 0) for s in ("train", "val", "test")) == want
        assert df.filter("split = 'train'").agg(F.max("node_id")).first()[0] == want[0] - 1


def test_bad_splits_raise(spark):
    nodes = spark.range(3).withColumnRenamed("id", "node_id").withColumn("timestamp", F.lit(1))
    with pytest.raises(ValueError):
        sampling.split_temporal(nodes, train=0.9, val=0.2)
    with pytest.raises(ValueError):
        sampling.split_temporal(nodes.limit(0))
    with pytest.raises(ValueError):
        sampling.split_temporal(nodes.drop("timestamp"))


def test_stratified_split_partitions_the_nodes(spark):
    nodes = spark.range(200).select(F.col("id").alias("node_id"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    got = sampling.split_stratified(nodes, "y").groupBy("y", "split").count().collect()
    assert {(r.y, r.split): r["count"] for r in got} == {
        (0, "train"): 120, (0, "val"): 15, (0, "test"): 15, (1, "train"): 40, (1, "val"): 5, (1, "test"): 5}


# --- text -------------------------------------------------------------------


def test_text_functions(spark):
    assert one(spark, text.clean_author(F.lit("Visit Amazon's  Jane Doe Page"))) == "Jane Doe"
    assert one(spark, text.clean_author(F.lit(" plain "))) == "plain"
    nested = F.array(F.array(F.lit("Books"), F.lit("A &amp; B")), F.array(F.lit(" "), F.lit("books ")), F.array(F.lit("C")))
    assert one(spark, text.flatten_and_filter(nested)) == ["A & B", "C"]
    assert one(spark, text.clean_html(F.lit("&lt;b&gt;Hi&lt;/b&gt;  <i>you</i>"))) == "Hi you"
    assert one(spark, text.clean_html(F.lit("a&nbsp;&nbsp; b&nbsp;"))) == "a b"
    assert one(spark, text.clean_html(F.lit(None).cast("string"))) == ""
    assert one(spark, text.parse_string_list(F.lit("['foo' 'bar baz']"))) == ["foo", "bar baz"]
    assert one(spark, text.parse_string_list(F.lit("[it's bad]"))) == ["it's", "bad"]
    assert one(spark, text.parse_string_list(F.lit(None).cast("string"))) == []
    assert one(spark, text.join_text_list(F.array(F.lit("<p>a</p>"), F.lit(None), F.lit(" "), F.lit("b  c")))) == "a b c"
    assert one(spark, text.format_cell(F.lit("abcdefgh"), False, 6)) == "abc..."
    assert one(spark, text.format_cell(F.array(F.lit("a"), F.lit(" "), F.lit(None), F.lit("b")), True)) == "a | b"


# --- dates and numbers ------------------------------------------------------


def test_date_features(spark):
    cells = spark.createDataFrame(
        [(0, ["2020-01-31", "2020-01-01", "2020-01-11"]), (1, ["2020-02-06"]), (2, []), (3, ["x", None])],
        "node_id long, d array<string>").withColumn("ref", F.lit("2020-02-10").cast("date"))
    want = {0: (10, 3, 15, 5), 1: (4, 1, -1, -1), 2: (-1, 0, -1, -1), 3: (-1, 0, -1, -1)}
    got = cells.select("node_id", *dates.date_features(dates.to_date_list(F.col("d")), F.col("ref"))).collect()
    assert {r.node_id: tuple(r)[1:] for r in got} == want
    long = cells.select("node_id", F.explode("d").alias("day"))
    got = dates.date_features_long(cells.select("node_id", "ref"), long, "day", "ref").collect()
    assert {r.node_id: tuple(round(r[c], 9) for c in dates.DATE_FEATURES) for r in got} == want


def test_date_similarity(spark):
    cells = spark.createDataFrame(
        [(0, ["2020-01-31", "2020-01-01", "2020-01-11"]), (1, []), (2, ["2020-02-06"])],
        "node_id long, d array<string>").withColumn("timestamp", F.lit("2020-02-10").cast("date"))
    assert pairs(sim_date(cells, "d", "timestamp", -1.0)) == {
        (0, 1): -0.962311, (0, 2): -0.869622, (1, 2): 0.702580}


def test_scaling(spark):
    df = spark.createDataFrame([(0.0, 3.0), (5.0, 3.0), (float("nan"), 3.0), (10.0, 3.0)], "x double, c double")
    got = numbers.minmax_scale(numbers.minmax_scale(df, "x", "x2"), "c", "c2").collect()
    assert [(r.x2, r.c2) for r in got] == [(0, 0), (0.5, 0), (0, 0), (1, 0)]
    bins = [one(spark, numbers.log_degree_bin(F.lit(d), F.lit(1500))) for d in (0, 8, 9, 98, 99, 999)]
    assert bins == [0, 0, 1, 1, 2, 3]
    for n in (1, 2, 9, 10, 11, 999, 1000, 1001):
        assert one(spark, numbers.degree_bins(F.lit(n))) == math.ceil(math.log10(n)) + 1


def test_remap_labels(spark):
    df = spark.createDataFrame([("b",), ("z",), ("b",)], "y string")
    assert sorted(r.y for r in numbers.remap_labels(df, "y", 2).collect()) == [0, 0, 1]
    with pytest.raises(ValueError):
        numbers.remap_labels(df, "y", 3)


# --- similarity -------------------------------------------------------------


def bags(spark, cells, kind):
    return spark.createDataFrame(list(enumerate(cells)), f"node_id long, v array<{kind}>")


def test_number_similarity(spark):
    nodes = spark.createDataFrame([(0, 3), (1, 5), (2, 3)], "node_id long, n int")
    assert pairs(S.sim_count(nodes, "n", 0.1)) == {(0, 1): 0.333333, (1, 2): 0.333333, (0, 2): 1.0}
    with pytest.raises(ValueError):
        S.sim_count(nodes, "n", 0.0)


def test_wasserstein_and_distribution(spark):
    def dist(a, b):
        array = [F.array(*[F.lit(float(x)) for x in v]) for v in (a, b)]
        return one(spark, S.wasserstein(*array))

    assert dist([0, 1], [5, 6]) == 5 and dist([1], [1, 3]) == 1
    nodes = bags(spark, [[], [1.0], [], [0.0, 1.0], [5.0, 6.0], [None, 1.0]], "double")
    got = pairs(S.sim_distribution(nodes, "v", 0.1))
    assert got[(0, 2)] == 1.0 and got[(3, 4)] == 0.166667 and got[(1, 5)] == 1.0
    assert (0, 1) not in got


def test_category_similarity(spark):
    nodes = spark.createDataFrame(list(enumerate(["a", "b", "c", None, None])), "node_id long, v string")
    assert pairs(S.sim_exact(nodes, "v")) == {(3, 4): 1.0}
    related = spark.createDataFrame([("a", "m"), ("b", "m")], "key string, related string")
    assert pairs(S.sim_grouped(nodes, "v", related)) == {(0, 1): 1.0, (3, 4): 1.0}
    numeric = spark.createDataFrame([(0, 1.0), (1, float("nan")), (2, None)], "node_id long, v double")
    assert pairs(S.sim_exact(numeric, "v")) == {(1, 2): 1.0}


def test_overlap(spark):
    nodes = bags(spark, [["x", "x", "y"], ["y", "z"], [], [], ["q", None]], "string")
    assert pairs(S.sim_overlap(nodes, "v")) == {(0, 1): 0.416667}
    related = spark.createDataFrame([("x", "x"), ("x", "z")], "key string, related string")
    # x reaches z: all of bag 0 meets bag 1; z itself reaches only z.
    assert pairs(S.sim_overlap(nodes, "v", related)) == {(0, 1): 0.75}


def test_rules(spark):
    nodes = bags(spark, [["a", "b", "c"]] * 3 + [["a"]] + [["d"]] * 4, "string")
    found = rules.frequent_itemsets(nodes, "v", 0.3)
    assert found.count() == 4 + 3 + 1
    lift = {("".join(r.antecedent), "".join(r.consequent)): round(r.lift, 4)
            for r in rules.association_rules(found, 1.2).collect()}
    assert lift[("c", "b")] == 2.6667 and lift[("a", "b")] == 2.0 and lift[("a", "bc")] == 2.0
    got = {(r.key, r.related) for r in rules.rule_map(rules.association_rules(found, 1.2)).collect()}
    assert got == {(x, y) for x in "abc" for y in "abc"}


# --- graphs -----------------------------------------------------------------


def path(spark):
    nodes = spark.createDataFrame([(i, int(i > 1)) for i in range(4)], "node_id long, y int")
    edges = G.undirected(spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 2)], "src long, dst long"))
    return nodes, G.Graph.from_edges(nodes, edges)


def test_metrics_on_a_path(spark):
    nodes, graph = path(spark)
    assert G.density(graph).first().density == 50.0
    mixing = G.mixing_counts(graph, nodes)
    assert G.homophily(mixing).first()[0] == pytest.approx(2 / 3)
    assert G.assortativity(mixing).first()[0] == pytest.approx(1 / 3)
    empty = G.Graph(graph.members, graph.links.limit(0))
    assert math.isnan(G.homophily(G.mixing_counts(empty, nodes)).first()[0])
    assert G.density(empty).first().density == 0.0


def test_edges_are_strict_and_skip_nan(spark):
    members = spark.createDataFrame([(i, i) for i in range(4)], "node_id long, cls long")
    table = spark.createDataFrame([(0, 1, .5, 1, 1), (0, 2, float("nan"), 1, 1), (0, 3, .6, 1, 1)],
                                  "a long, b long, sim double, m_a long, m_b long")
    got = G.build_edges(S.Similarity(members, table, "sparse"), 0.5).collect()
    assert {tuple(r) for r in got} == {(0, 3), (3, 0)}


def test_mixtures(spark):
    configs = G.mixture_configs(["a", "b", "c"], random=False)
    assert len(configs) == 7 and configs[-1]["type"] == "balanced"
    drawn = G.mixture_configs(["a", "b"], n_random=3, first_no=5, seed=1)
    assert [c["type"] for c in drawn] == ["random_5", "random_6", "random_7"]
    assert all(abs(c["a"] + c["b"] - 1) < 1e-12 for c in drawn)
    assert G.config_table(spark, configs).count() == 21


def values(df, column):
    return [round(r[column], 6) for r in df.orderBy("node_id").collect()]


def test_propagation_on_a_path(spark):
    _, graph = path(spark)
    x = spark.createDataFrame([(i, float(i == 0), float(i + 1)) for i in range(4)], "node_id long, e double, v double")
    assert values(propagate.propagate_gcn(graph, x, ["e"]), "e") == [0.5, 0.408248, 0, 0]
    assert values(propagate.propagate_sage(graph, x, ["v"]), "n1_v") == [2, 2, 3, 3]
    assert values(propagate.propagate_sage(graph, x, ["v"], 1, "max"), "n1_v") == [2, 3, 4, 3]
    assert values(propagate.propagate_gin(graph, x, ["v"]), "v") == [3, 6, 9, 7]


def test_neighbour_samples(spark):
    assert propagate.default_fanouts(4) == [25, 10, 5, 5] and propagate.default_fanouts(1) == [25]
    star = G.undirected(spark.createDataFrame([(0, i) for i in range(1, 20)], "src long, dst long"))
    seeds = spark.createDataFrame([(0,)], "node_id long")
    got = propagate.sample_neighbors(star, seeds, [5, 2]).collect()
    first = [r for r in got if r.hop == 1]
    assert len(first) == 5 and all(r.dst == 0 for r in first)
    assert {(r.src, r.dst) for r in got if r.hop == 2} == {(0, r.src) for r in first}


# --- evaluation -------------------------------------------------------------


def test_binary_measures(spark):
    scored = spark.createDataFrame(
        list(zip([1, 1, 0, 0, 1], [.9, .8, .8, .3, .2], ["val"] * 5)), "y int, p double, split string")
    assert evaluate.auroc(scored).first().auroc == pytest.approx(0.583333, abs=1e-6)
    best = evaluate.best_threshold(scored).first()
    assert (best.threshold, round(best.f1, 6)) == (0.01, 0.75)
    assert math.isnan(evaluate.auroc(scored.filter("y = 1")).first().auroc)
    none = evaluate.best_threshold(scored.filter("y = 0")).first()
    assert (none.threshold, none.f1) == (0.5, 0.0)


def test_class_absent_gives_nan(spark):
    rows_ = [("val", 0, [.6, .3, .1]), ("val", 1, [.2, .7, .1])]
    scored = spark.createDataFrame(rows_, "split string, y int, probs array<double>")
    assert math.isnan(evaluate.auroc_ovr_macro(scored).first().auroc)


def test_alignment(spark):
    a = spark.createDataFrame([(0, 5), (1, 6)], "node_id long, customer_id long")
    rows.assert_aligned(a, a, "node_id", "customer_id")
    with pytest.raises(ValueError):
        rows.assert_aligned(a, a.limit(1), "node_id", "customer_id")
    with pytest.raises(ValueError):
        rows.assert_aligned(a, a.withColumn("customer_id", F.lit(5)), "node_id", "customer_id")
    with pytest.raises(ValueError):
        rows.require_columns(a, ["nope"])
