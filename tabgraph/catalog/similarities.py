"""Similarity joins, rules and graphs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabgraph.catalog.registry import query
from tabgraph.catalog.rounding import r6, rounded
from tabgraph.operators import graph as G
from tabgraph.operators import propagate, rules
from tabgraph.operators import similarity as sim
from tabgraph.operators.date_similarity import sim_date_features
from tabgraph.operators.text_similarity import embed_text, sim_text
from tabgraph.functions.dates import date_features_long
from tabgraph.sources import adapters as src


# --- node tables ------------------------------------------------------------


def customer_counts(spark, sf_dir):
    """node_id, n_orders, acctbal, segment, nation of every customer."""
    counts = src.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("node_id")).agg(
        F.count(F.lit(1)).alias("n_orders"))
    customers = src.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("node_id"), F.col("c_acctbal").alias("acctbal"),
        F.expr("nullif(c_mktsegment, 'BUILDING')").alias("segment"),
        F.col("c_nationkey").alias("nation"))
    return customers.join(counts, "node_id", "left").withColumn(
        "n_orders", F.coalesce("n_orders", F.lit(0)))


CUSTOMERS = """nodes as (
  select c_custkey as node_id, c_acctbal as acctbal, nullif(c_mktsegment, 'BUILDING') as segment,
    c_nationkey as nation, (select count(*) from orders where o_custkey = c_custkey) as n_orders
  from customer)"""


def customers_only(spark, sf_dir):
    return src.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"))


def price_items(spark, sf_dir):
    """(node_id, item): the order values of every customer, in 100,000s."""
    return src.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("node_id"), (F.col("o_totalprice") / 100000).alias("item"))


def order_baskets(spark, sf_dir):
    """node_id and the distinct product categories of every order with items."""
    lines = src.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = src.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    return lines.join(parts, "l_partkey").groupBy(F.col("l_orderkey").alias("node_id")).agg(
        F.array_sort(F.collect_set("p_type")).alias("items"))


def order_items(spark, sf_dir):
    """(node_id, item): the products every order holds."""
    return src.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("node_id"), F.col("l_partkey").alias("item"))


def orders_with_items(spark, sf_dir):
    return order_items(spark, sf_dir).select("node_id").distinct()


def product_map(spark, sf_dir):
    """Every third product is related to the next two, and to itself."""
    parts = src.table(spark, sf_dir, "part").filter("p_partkey % 3 = 0")
    return parts.select(
        F.col("p_partkey").alias("key"),
        F.explode(F.sequence(F.col("p_partkey"), F.col("p_partkey") + 2)).alias("related"))


def vectors(spark, sf_dir):
    return src.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("node_id"), "embedding", F.col("label").alias("y"))


def classes_of(similarity):
    return rounded(similarity.pairs)


# --- numbers ----------------------------------------------------------------

COUNT_CLASSES = f"""
with {CUSTOMERS}, g as (select cast(n_orders as double) as v, count(*) as m from nodes group by 1)
select x.v as a, y.v as b, round(1 / (1 + abs(x.v - y.v)), 6) as sim, x.m as m_a, y.m as m_b
from g x join g y on x.v <= y.v where 1 / (1 + abs(x.v - y.v)) > 0.2 and (x.v < y.v or x.m > 1)"""


@query("x1_sim_count", COUNT_CLASSES)
def x1_sim_count(spark, sf_dir):
    return classes_of(sim.sim_count(customer_counts(spark, sf_dir), "n_orders", 0.2))


@query("x2_sim_count_checked", COUNT_CLASSES)
def x2_sim_count_checked(spark, sf_dir):
    nodes = customer_counts(spark, sf_dir).withColumn("customer_id", F.col("node_id"))
    return classes_of(sim.sim_count_checked(
        nodes.select("node_id", "customer_id"), nodes, 0.2, "n_orders"))


@query("x3_sim_numeric", """
with n as (select c_custkey as node_id, (c_acctbal - lo) / (hi - lo) as v
  from customer, (select min(c_acctbal) as lo, max(c_acctbal) as hi from customer))
select x.node_id as src, y.node_id as dst, round(1 / (1 + abs(x.v - y.v)), 6) as sim
from n x join n y on x.node_id < y.node_id where 1 / (1 + abs(x.v - y.v)) > 0.999""")
def x3_sim_numeric(spark, sf_dir):
    nodes = customer_counts(spark, sf_dir)
    return rounded(sim.sim_numeric(nodes, "acctbal", 0.999).between_nodes())


W_PAIRS = """
with v as (select o_custkey as node_id, o_totalprice / 100000 as x from orders),
c as (select node_id, count(*) as n from v group by 1),
steps as (
  select p.node_id as a, q.node_id as b, x, 1.0 / p.n as w from c p join c q on p.node_id < q.node_id
    join v on v.node_id = p.node_id
  union all
  select p.node_id, q.node_id, x, -1.0 / q.n from c p join c q on p.node_id < q.node_id
    join v on v.node_id = q.node_id),
swept as (select a, b, x, sum(w) over (partition by a, b order by x rows unbounded preceding) as gap,
    lead(x) over (partition by a, b order by x) as nxt from steps),
dist as (select a, b, sum(abs(gap) * coalesce(nxt - x, 0)) as d from swept group by a, b)"""


@query("x4_x5_sim_distribution", W_PAIRS + """
, e as (select c_custkey as node_id from customer where c_custkey not in (select o_custkey from orders))
select a as src, b as dst, round(1 / (1 + d), 5) as sim from dist where 1 / (1 + d) > 0.8
union all select x.node_id, y.node_id, 1.0 from e x join e y on x.node_id < y.node_id""")
def x4_x5_sim_distribution(spark, sf_dir):
    pairs = sim.sim_distribution_items(
        customers_only(spark, sf_dir), price_items(spark, sf_dir), 0.8).between_nodes()
    return pairs.withColumn("sim", F.round("sim", 5))


# --- categories -------------------------------------------------------------


@query("x6_sim_exact", f"""
with {CUSTOMERS}, g as (select coalesce('=' || segment, 'missing') as v, count(*) as m from nodes group by 1)
select v as a, v as b, 1.0::double as sim, m as m_a, m as m_b from g where m > 1""")
def x6_sim_exact(spark, sf_dir):
    return classes_of(sim.sim_exact(customer_counts(spark, sf_dir), "segment"))


def brand_map(spark, sf_dir):
    """Every third brand number is related to the next two."""
    no = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    brands = src.table(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), no.alias("no")).distinct()
    return brands.filter("no % 3 = 0").select(
        "key", F.explode(F.array(*[F.concat(F.lit("Brand#"), (F.col("no") + d).cast("string")) for d in (1, 2)])).alias("related"))


BRAND_MAP = """map as (
  select distinct p_brand as key, 'Brand#' || (cast(p_brand[7:] as int) + d) as related
  from part, range(1, 3) r(d) where cast(p_brand[7:] as int) % 3 = 0)"""


@query("x7_sim_grouped", f"""
with {BRAND_MAP}, g as (select p_brand as v, count(*) as m from part group by 1),
ex as (select v, v as token from g union select v, related from g join map on key = v),
met as (select distinct x.v as v1, y.v as v2 from ex x join ex y on x.token = y.token and x.v <= y.v)
select '=' || least(v1, v2) as a, '=' || greatest(v1, v2) as b, 1.0::double as sim,
  p.m as m_a, q.m as m_b
from met join g p on p.v = least(v1, v2) join g q on q.v = greatest(v1, v2)
where v1 <> v2 or p.m > 1""")
def x7_sim_grouped(spark, sf_dir):
    parts = src.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), "p_brand")
    return classes_of(sim.sim_grouped(parts, "p_brand", brand_map(spark, sf_dir)))


ITEMSETS = """
baskets as (select l_orderkey, list_sort(list(distinct p_type)) as items
  from lineitem join part on p_partkey = l_partkey group by 1),
subsets as (select list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = 1) as items
  from baskets, unnest(range(1, 1 << len(items))) u(mask)),
sets as (select items, count(*) as freq, count(*)::double / (select count(*) from baskets) as support
  from subsets group by 1 having count(*) >= 0.03 * (select count(*) from baskets)),
split as (select list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = 1) as ante,
    list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = 0) as cons, support
  from sets, unnest(range(1, (1 << len(items)) - 1)) u(mask) where len(items) > 1),
rules as (select ante, cons, p.support, p.support / a.support as confidence,
    p.support / (a.support * c.support) as lift
  from split p join sets a on a.items = ante join sets c on c.items = cons
  where p.support / (a.support * c.support) >= 0.85)"""


@query("x8_frequent_itemsets", f"""
with {ITEMSETS} select array_to_string(items, ',') as items, freq, round(support, 6) as support from sets""")
def x8_frequent_itemsets(spark, sf_dir):
    found = rules.frequent_itemsets(order_baskets(spark, sf_dir), "items", 0.03)
    return rounded(found.withColumn("items", F.array_join("items", ",")))


def _rules(spark, sf_dir):
    found = rules.frequent_itemsets(order_baskets(spark, sf_dir), "items", 0.03)
    return rules.association_rules(found, 0.85)


@query("x9_association_rules", f"""
with {ITEMSETS} select array_to_string(ante, ',') as antecedent, array_to_string(cons, ',') as consequent,
  round(support, 6) as support, round(confidence, 6) as confidence, round(lift, 6) as lift from rules""")
def x9_association_rules(spark, sf_dir):
    return rounded(_rules(spark, sf_dir).withColumns({
        "antecedent": F.array_join("antecedent", ","), "consequent": F.array_join("consequent", ",")}))


@query("x10_rule_map", f"""
with {ITEMSETS}, one as (select distinct k, unnest(cons) as r from (select unnest(ante) as k, cons from rules))
select k as key, r as related from one union select r, k from one union select k, k from one
union select r, r from one""")
def x10_rule_map(spark, sf_dir):
    return rules.rule_map(_rules(spark, sf_dir))


PRODUCT_BAGS = """
counted as (select l_orderkey as node_id, l_partkey::varchar as item, count(*) as w from lineitem group by 1, 2),
bags as (select node_id, sum(w) as total, md5('[' || string_agg('{"x":"' || item || '","n":' || w || '}', ','
    order by item) || ']') as cls from counted group by node_id),
g as (select cls, count(*) as m, min(node_id) as id from bags group by cls),
it as (select g.cls, m, total, item, w::double as w from g join bags b on b.node_id = g.id
  join counted c on c.node_id = g.id)"""


@query("x11_sim_overlap", f"""
with {PRODUCT_BAGS}, half as (select x.cls as p, y.cls as q, sum(x.w) / x.total as share
  from it x join it y on x.item = y.item and x.cls <> y.cls group by x.cls, y.cls, x.total),
joint as (select least(p, q) as a, greatest(p, q) as b, sum(share) / 2 as sim from half group by 1, 2)
select a, b, round(sim, 6) as sim, x.m as m_a, y.m as m_b from joint join g x on x.cls = a
  join g y on y.cls = b where sim > 0.3
union all select cls, cls, 1.0, m, m from g where m > 1""")
def x11_sim_overlap(spark, sf_dir):
    return classes_of(sim.sim_overlap_items(
        orders_with_items(spark, sf_dir), order_items(spark, sf_dir), min_sim=0.3))


@query("x11_sim_overlap_map", f"""
with {PRODUCT_BAGS}, map as (select p_partkey::varchar as item, (p_partkey + d)::varchar as related
  from part, range(3) r(d) where p_partkey % 3 = 0),
ex as (select cls, total, item, w, coalesce(related, item) as token from it left join map using (item)),
hits as (select distinct x.cls as p, y.cls as q, x.item, x.w, x.total from ex x join it y on x.token = y.item),
half as (select p, q, sum(w) / any_value(total) as share from hits where p <> q group by p, q),
joint as (select least(p, q) as a, greatest(p, q) as b, sum(share) / 2 as sim from half group by 1, 2)
select a, b, round(sim, 6) as sim, x.m as m_a, y.m as m_b from joint join g x on x.cls = a
  join g y on y.cls = b where sim > 0.4
union all select cls, cls, 1.0, m, m from g where m > 1""")
def x11_sim_overlap_map(spark, sf_dir):
    return classes_of(sim.sim_overlap_items(
        orders_with_items(spark, sf_dir), order_items(spark, sf_dir), product_map(spark, sf_dir), 0.4))


# --- text, vectors, dates ---------------------------------------------------

TERMS = r"""
clean as (select doc_id, trim(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) as text
  from documents),
words as (select doc_id, term, count(*) as tf from (select doc_id,
    unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) as term from clean)
  where term <> '' group by 1, 2),
df as (select term, count(*) as df from words group by 1),
raw as (select doc_id, term, tf * ln(((select count(*) from documents) + 1) / (df + 1)) as w
  from words join df using (term)),
weights as (select doc_id, term, w / sqrt(sum(w * w) over (partition by doc_id)) as w from raw where w > 0)"""


@query("x12_embed_text", f"with {TERMS} select doc_id as node_id, term, round(w, 6) as weight from weights")
def x12_embed_text(spark, sf_dir):
    return rounded(embed_text(src.table(spark, sf_dir, "documents"), "text", "doc_id"))


@query("x13_sim_cosine", """
select x.vec_id as src, y.vec_id as dst,
  round(list_cosine_similarity(x.embedding::double[], y.embedding::double[]), 6) as sim
from embeddings x join embeddings y on x.vec_id < y.vec_id
where list_cosine_similarity(x.embedding::double[], y.embedding::double[]) > 0.3""")
def x13_sim_cosine(spark, sf_dir):
    return rounded(sim.sim_cosine(vectors(spark, sf_dir), "embedding", 0.3).between_nodes())


@query("x13_sim_cosine_lsh")
def x13_sim_cosine_lsh(spark, sf_dir):
    return rounded(sim.sim_cosine_lsh(vectors(spark, sf_dir), "embedding", 0.3).between_nodes())


@query("x14_sim_text", f"""
with {TERMS} select x.doc_id as src, y.doc_id as dst, round(sum(x.w * y.w), 5) as sim
from weights x join weights y on x.term = y.term and x.doc_id < y.doc_id
group by 1, 2 having sum(x.w * y.w) > 0.5""")
def x14_sim_text(spark, sf_dir):
    documents = src.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), "text")
    pairs = sim_text(documents, "text", 0.5).between_nodes()
    return pairs.withColumn("sim", F.round("sim", 5))


DATE_ROWS = """
d as (select o_custkey as node_id, cast(o_orderdate as date) as day from orders),
gaps as (select node_id, day, day - lag(day) over (partition by node_id order by day) as gap from d),
f as (select c_custkey as node_id,
    coalesce(date '2001-08-01' - max(day), -1)::double as days_since_reference,
    count(day)::double as total_count,
    coalesce(avg(gap), -1)::double as avg_interval,
    coalesce(stddev_pop(gap), -1)::double as std_interval
  from customer left join gaps on node_id = c_custkey group by 1)"""


def _date_features(spark, sf_dir):
    orders = src.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("node_id"), "o_orderdate")
    nodes = src.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("node_id"), F.lit("2001-08-01").cast("date").alias("ref"))
    return date_features_long(nodes, orders, "o_orderdate", "ref").drop("ref")


@query("t13_date_features", f"""
with {DATE_ROWS} select node_id, days_since_reference, total_count,
  round(avg_interval, 6) as avg_interval, round(std_interval, 6) as std_interval from f""")
def t13_date_features(spark, sf_dir):
    return rounded(_date_features(spark, sf_dir))


@query("x15_sim_date", f"""
with {DATE_ROWS}, z as (select node_id,
    (days_since_reference - avg(days_since_reference) over ()) / stddev_pop(days_since_reference) over () as p,
    (total_count - avg(total_count) over ()) / stddev_pop(total_count) over () as q,
    (avg_interval - avg(avg_interval) over ()) / stddev_pop(avg_interval) over () as r,
    (std_interval - avg(std_interval) over ()) / stddev_pop(std_interval) over () as s from f),
u as (select node_id, [p, q, r, s] as v from z)
select x.node_id as src, y.node_id as dst, round(list_cosine_similarity(x.v, y.v), 5) as sim
from u x join u y on x.node_id < y.node_id where list_cosine_similarity(x.v, y.v) > 0.99""")
def x15_sim_date(spark, sf_dir):
    pairs = sim_date_features(_date_features(spark, sf_dir), 0.99).between_nodes()
    return pairs.withColumn("sim", F.round("sim", 5))


# --- graphs -----------------------------------------------------------------

COSINES = """cosines as (select x.vec_id as src, y.vec_id as dst,
    list_cosine_similarity(x.embedding::double[], y.embedding::double[]) as sim
  from embeddings x join embeddings y on x.vec_id < y.vec_id)"""


@query("g1_normalize_pairs", f"""
with {COSINES} select src, dst, round((sim - lo) / (1.0 - lo), 6) as sim
from cosines, (select min(sim) as lo from cosines)""")
def g1_normalize_pairs(spark, sf_dir):
    full = sim.sim_cosine(vectors(spark, sf_dir), "embedding", -1.0)
    return rounded(G.normalize_pairs(full).between_nodes())


def _mixture(spark, sf_dir):
    nodes = customer_counts(spark, sf_dir)
    parts = {"segment": sim.sim_exact(nodes, "segment"), "nation": sim.sim_exact(nodes, "nation")}
    return G.combine_pairs(parts, G.mixture_configs(list(parts), random=False))


@query("g2_g3_combine_pairs", f"""
with {CUSTOMERS}, p as (select (x.segment is not distinct from y.segment)::int as s,
    (x.nation = y.nation)::int as n from nodes x join nodes y on x.node_id < y.node_id),
c(config, ws, wn) as (values ('pure_segment', 1.0, 0.0), ('pure_nation', 0.0, 1.0),
  ('pair_segment_nation', 0.5, 0.5), ('balanced', 0.5, 0.5))
select config, round(ws * s + wn * n, 6)::double as sim, count(*) as n_pairs from p cross join c
where ws * s + wn * n > 0 group by 1, 2""")
def g2_g3_combine_pairs(spark, sf_dir):
    tables = [
        mixed.weighted().groupBy(r6("sim").alias("sim")).agg(F.sum("weight").alias("n_pairs"))
        .withColumn("config", F.lit(name))
        for name, mixed in _mixture(spark, sf_dir).items()
    ]
    from tabgraph.operators.rows import union_all

    return union_all(tables)


def _vector_graph(spark, sf_dir):
    return G.Graph.above(sim.sim_cosine(vectors(spark, sf_dir), "embedding", 0.25), 0.25)


VECTOR_EDGES = f"""{COSINES}, half as (select src, dst from cosines where sim > 0.25),
edges as (select src, dst from half union all select dst, src from half)"""


@query("g4_u4_build_edges", f"with {VECTOR_EDGES} select src, dst from edges")
def g4_u4_build_edges(spark, sf_dir):
    return G.build_edges(sim.sim_cosine(vectors(spark, sf_dir), "embedding", 0.25), 0.25)


def _count_graph(spark, sf_dir):
    """Customers whose order counts differ by at most one."""
    nodes = customer_counts(spark, sf_dir)
    return nodes, G.Graph.above(sim.sim_count(nodes, "n_orders", 0.4), 0.4)


COUNT_EDGES = f"""{CUSTOMERS}, edges as (select x.node_id as src, y.node_id as dst from nodes x
  join nodes y on x.node_id <> y.node_id and abs(x.n_orders - y.n_orders) <= 1)"""


@query("g5_density", f"""
with {COUNT_EDGES}, e as (select count(*) // 2 as n_edges from edges), n as (select count(*) as n_nodes from nodes)
select n_nodes, n_edges, round(n_edges / (n_nodes * (n_nodes - 1) / 2) * 100, 6) as density from e, n""")
def g5_density(spark, sf_dir):
    return rounded(G.density(_count_graph(spark, sf_dir)[1]))


BISECT = """
n as (select {count} as n_nodes),
search as (
  select 0 as step, 0.0::double as low, 1.0::double as high, 0.0::double as best,
    1e300::double as closest, false as done
  union all
  select step + 1,
    case when stop or d <= {target} then low else mid end,
    case when stop or d > {target} then high else mid end,
    case when not stop and abs(d - {target}) < closest then mid else best end,
    case when not stop and abs(d - {target}) < closest then abs(d - {target}) else closest end,
    stop or least(closest, abs(d - {target})) <= 0.1
  from (select *, high - low < 1e-6 as stop, (low + high) / 2 as mid,
      (select count(*) from sims where sim > (low + high) / 2)
        / (n_nodes * (n_nodes - 1) / 2) * 100 as d
    from search, n where not done and step < 100))
select best as threshold from search order by step desc limit 1"""


@query("g6_threshold_for_density", f"""
with recursive {COSINES}, sims as (select sim from cosines),
{BISECT.format(count='(select count(*) from embeddings)', target=5.0)}""")
def g6_threshold_for_density(spark, sf_dir):
    nodes = vectors(spark, sf_dir)
    histogram = sim.cosine_histogram(nodes, "embedding", G.SCALE)
    found = G.threshold_for_density(histogram, nodes.count(), 5.0)
    return nodes.agg(F.lit(found).alias("threshold"))


@query("g6_threshold_numeric", f"""
with recursive v as (select c_custkey as id, (c_acctbal - lo) / (hi - lo) as v
  from customer, (select min(c_acctbal) as lo, max(c_acctbal) as hi from customer)),
sims as (select 1 / (1 + abs(x.v - y.v)) as sim from v x join v y on x.id < y.id),
{BISECT.format(count='(select count(*) from customer)', target=3.0)}""")
def g6_threshold_numeric(spark, sf_dir):
    from tabgraph.functions.numbers import minmax_scale

    nodes = minmax_scale(customer_counts(spark, sf_dir).select("node_id", "acctbal"), "acctbal", "v")
    found = G.threshold_for_density_numeric(nodes, "v", 3.0)
    return nodes.agg(F.lit(found).alias("threshold"))


@query("g7_degree", f"""
with {COUNT_EDGES} select node_id, count(dst) as degree from nodes left join edges on src = node_id group by 1""")
def g7_degree(spark, sf_dir):
    return G.degree(_count_graph(spark, sf_dir)[1])


@query("t16_t17_g8_degree_features", f"""
with {COUNT_EDGES}, d as (select node_id, count(dst) as degree from nodes left join edges on src = node_id group by 1),
b as (select node_id, least(floor(log10(degree + 1)), ceil(log10((select count(*) from nodes)))) as bin from d)
select node_id, bin::double as bin_no, 1.0::double as bins_set from b""")
def t16_t17_g8_degree_features(spark, sf_dir):
    nodes, graph = _count_graph(spark, sf_dir)
    hot = G.degree_features(graph, nodes.count())
    flags = [c for c in hot.columns if c.startswith("deg_bin_")]
    return hot.select(
        "node_id", sum(F.col(c) * i for i, c in enumerate(flags)).alias("bin_no"),
        sum(F.col(c) for c in flags).alias("bins_set"))


MIXING = """mixing as (select x.y as y_src, z.y as y_dst, count(*) as n from edges
  join lab x on x.node_id = src join lab z on z.node_id = dst group by 1, 2)"""
SEGMENT_LABEL = "lab as (select node_id, coalesce(segment, 'none') as y from nodes)"


def _segment_labels(nodes):
    return nodes.select("node_id", F.coalesce("segment", F.lit("none")).alias("y"))


@query("a11_mixing_counts", f"with {COUNT_EDGES}, {SEGMENT_LABEL}, {MIXING} select * from mixing")
def a11_mixing_counts(spark, sf_dir):
    nodes, graph = _count_graph(spark, sf_dir)
    return G.mixing_counts(graph, _segment_labels(nodes))


@query("g10_homophily", f"""
with {VECTOR_EDGES}, lab as (select vec_id as node_id, label as y from embeddings), {MIXING}
select round(sum(n) filter (y_src = y_dst) / sum(n), 6) as homophily_ratio from mixing""")
def g10_homophily(spark, sf_dir):
    nodes = vectors(spark, sf_dir)
    return rounded(G.homophily(G.mixing_counts(_vector_graph(spark, sf_dir), nodes)))


ASSORT = """share as (select y_src as i, y_dst as j, n / (sum(n) over ()) as e from mixing),
marg as (select i, sum(e) as a from share group by i),
assort as (select ((select sum(e) from share where i = j) - sum(a * a)) / (1 - sum(a * a) + 1e-12) as r from marg)"""


@query("g11_assortativity", f"""
with {COUNT_EDGES}, {SEGMENT_LABEL}, {MIXING}, {ASSORT} select round(r, 6) + 0.0 as assortativity from assort""")
def g11_assortativity(spark, sf_dir):
    nodes, graph = _count_graph(spark, sf_dir)
    return rounded(G.assortativity(G.mixing_counts(graph, _segment_labels(nodes))))


@query("g12_graph_summary", f"""
with {COUNT_EDGES}, {SEGMENT_LABEL}, {MIXING}, {ASSORT},
e as (select count(*) // 2 as n_edges from edges), c as (select count(*) as n_nodes from nodes)
select n_nodes, n_edges, round(n_edges / (n_nodes * (n_nodes - 1) / 2) * 100, 6) as density,
  round(r, 6) + 0.0 as assortativity,
  round((select sum(n) filter (y_src = y_dst) / sum(n) from mixing), 6) as homophily_ratio,
  'n_orders' as data_column, 0.4::double as threshold from e, c, assort""")
def g12_graph_summary(spark, sf_dir):
    nodes, graph = _count_graph(spark, sf_dir)
    return rounded(G.graph_summary(
        graph, _segment_labels(nodes), data_column="n_orders", threshold=0.4))


@query("w4_top_n_similar", """
select y.vec_id as node_index,
  round(list_cosine_similarity(x.embedding::double[], y.embedding::double[]), 6) as similarity,
  'vec ' || y.vec_id as feature, y.label
from embeddings x join embeddings y on x.vec_id = 7 and y.vec_id <> 7
order by similarity desc, node_index limit 10""")
def w4_top_n_similar(spark, sf_dir):
    from tabgraph.functions.text import format_cell

    nodes = vectors(spark, sf_dir)
    text = F.concat(F.lit("vec "), F.col("node_id").cast("string"))
    return rounded(G.top_n_by_vector(nodes, "embedding", 7, format_cell(text, False), 10, "y")).withColumnRenamed(
        "y", "label")


@query("w5_top_n_similar_all", f"""
with {CUSTOMERS}, p as (select x.node_id, y.node_id as neighbour,
    1.0::double / (1 + abs(x.n_orders - y.n_orders)) as sim from nodes x join nodes y on x.node_id <> y.node_id)
select node_id, row_number() over (partition by node_id order by sim desc, neighbour)::int as rank,
  neighbour, round(sim, 6) as similarity from p qualify rank <= 5""")
def w5_top_n_similar_all(spark, sf_dir):
    return rounded(G.top_n_closest(customer_counts(spark, sf_dir), "n_orders", 5))


@query("w5_top_n_sparse", f"""
with {CUSTOMERS}, p as (select x.node_id, y.node_id as neighbour,
    case when x.n_orders = y.n_orders and x.nation = y.nation then 1.0::double else 0 end as sim
  from nodes x join nodes y on x.node_id <> y.node_id)
select node_id, row_number() over (partition by node_id order by sim desc, neighbour)::int as rank,
  neighbour, sim as similarity from p qualify rank <= 20""")
def w5_top_n_sparse(spark, sf_dir):
    both = F.concat_ws("|", F.col("n_orders").cast("string"), F.col("nation").cast("string"))
    nodes = customer_counts(spark, sf_dir).withColumn("both", both)
    return G.top_n_similar_all(sim.sim_exact(nodes, "both"), 20)


@query("x1_sim_count_nulls", f"""
with {CUSTOMERS}, v as (select case when n_orders % 5 <> 0 then n_orders end as n from nodes),
c as (select n::double as n, count(*) as m from v where n is not null group by 1)
select a.n as a, b.n as b, round(1.0::double / (1 + abs(a.n - b.n)), 6) as sim, a.m as m_a, b.m as m_b
from c a join c b on a.n < b.n or (a.n = b.n and a.m > 1)
where 1.0::double / (1 + abs(a.n - b.n)) > 0.2""")
def x1_sim_count_nulls(spark, sf_dir):
    nodes = customer_counts(spark, sf_dir)
    some = nodes.withColumn("n_orders", F.when(F.col("n_orders") % 5 != 0, F.col("n_orders")))
    return rounded(sim.sim_count(some, "n_orders", 0.2).pairs)


@query("s9_similarity_map", """
with m as (select p_brand as key, list(distinct p_type) as related, count(*) as n from part group by 1)
select distinct key, unnest(case when n % 2 = 0 then related else [key] end) as related from m""")
def s9_similarity_map(spark, sf_dir):
    from tabgraph.sources.tables import similarity_map

    lists = src.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("key")).agg(
        F.collect_set("p_type").alias("related"), F.count(F.lit(1)).alias("n"))
    return similarity_map(lists.withColumn("related", F.when(F.col("n") % 2 == 0, F.col("related"))))


@query("u4_undirected", """
with e as (select o_custkey as src, o_orderkey as dst from orders)
select src, dst from e union select dst, src from e""")
def u4_undirected(spark, sf_dir):
    orders = src.table(spark, sf_dir, "orders")
    return G.undirected(orders.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst")))


# --- message passing --------------------------------------------------------

LAYER = """deg as (select node_id, count(dst) as d from nodes left join edges on src = node_id group by 1)"""


@query("l1_propagate_gcn", f"""
with {COUNT_EDGES}, {LAYER},
e2 as (select src, dst from edges union all select node_id, node_id from nodes),
h1 as (select e2.src as node_id, sum(x.acctbal / sqrt((p.d + 1) * (q.d + 1))) as v from e2
  join deg p on p.node_id = src join deg q on q.node_id = dst join nodes x on x.node_id = dst group by 1),
h2 as (select e2.src as node_id, sum(x.v / sqrt((p.d + 1) * (q.d + 1))) as v from e2
  join deg p on p.node_id = src join deg q on q.node_id = dst join h1 x on x.node_id = dst group by 1)
select node_id, round(v, 4) as acctbal from h2""")
def l1_propagate_gcn(spark, sf_dir):
    nodes, graph = _count_graph(spark, sf_dir)
    out = propagate.propagate_gcn(graph, nodes.select("node_id", "acctbal"), ["acctbal"], 2)
    return out.withColumn("acctbal", F.round("acctbal", 4))


def _sage(spark, sf_dir, aggr):
    nodes, graph = _count_graph(spark, sf_dir)
    x = nodes.select("node_id", F.sqrt(F.col("acctbal") + 1000).alias("x"))
    return rounded(propagate.propagate_sage(graph, x, ["x"], 1, aggr))


def _sage_sql(aggr):
    return f"""with {COUNT_EDGES} select n.node_id, round(sqrt(n.acctbal + 1000), 6) as x,
      round(coalesce({aggr}(sqrt(x.acctbal + 1000)), 0), 6) as n1_x from nodes n
      left join edges on src = n.node_id left join nodes x on x.node_id = dst group by n.node_id, n.acctbal"""


@query("l2_propagate_sage_mean", _sage_sql("avg"))
def l2_propagate_sage_mean(spark, sf_dir):
    return _sage(spark, sf_dir, "mean")


@query("l2_propagate_sage_max", _sage_sql("max"))
def l2_propagate_sage_max(spark, sf_dir):
    return _sage(spark, sf_dir, "max")


@query("l2_propagate_sage_sum", _sage_sql("sum"))
def l2_propagate_sage_sum(spark, sf_dir):
    return _sage(spark, sf_dir, "sum")


@query("l3_propagate_gin", f"""
with {VECTOR_EDGES}, x as (select vec_id as node_id, unnest(embedding)::double as v, unnest(range(64))::integer as pos from embeddings)
select n.node_id, n.pos, round(n.v + coalesce(sum(m.v), 0), 6) as v from x n left join edges on src = n.node_id
left join x m on m.node_id = dst and m.pos = n.pos group by n.node_id, n.pos, n.v""")
def l3_propagate_gin(spark, sf_dir):
    nodes = vectors(spark, sf_dir)
    columns = [f"x{i}" for i in range(64)]
    x = nodes.select("node_id", *[F.element_at("embedding", i + 1).cast("double").alias(c) for i, c in enumerate(columns)])
    summed = propagate.propagate_gin(_vector_graph(spark, sf_dir), x, columns)
    return rounded(summed.select("node_id", F.posexplode(F.array(*columns)).alias("pos", "v")))


@query("l4_sample_neighbors", f"""
with {VECTOR_EDGES}, f0 as (select vec_id // 64 as batch, vec_id as dst from embeddings),
s1 as (select batch, f0.dst, e.dst as src from f0 join edges e on e.src = f0.dst
  qualify row_number() over (partition by batch, f0.dst order by
    md5('42|1|' || batch || '|' || f0.dst || '|' || e.dst), e.dst) <= 4),
f1 as (select distinct batch, src as dst from s1 except select batch, dst from f0),
s2 as (select batch, f1.dst, e.dst as src from f1 join edges e on e.src = f1.dst
  qualify row_number() over (partition by batch, f1.dst order by
    md5('42|2|' || batch || '|' || f1.dst || '|' || e.dst), e.dst) <= 3)
select batch, 1 as hop, src, dst from s1 union all select batch, 2, src, dst from s2""")
def l4_sample_neighbors(spark, sf_dir):
    nodes = vectors(spark, sf_dir)
    edges = G.build_edges(sim.sim_cosine(nodes, "embedding", 0.25), 0.25)
    return propagate.sample_neighbors(edges, nodes.select("node_id"), [4, 3], batch_size=64)
