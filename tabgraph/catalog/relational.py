"""Feature frame, joins, aggregates, top-k and sampling over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabgraph.catalog.registry import FACT, PRODUCT, TRAIN, query
from tabgraph.catalog.rounding import rounded
from tabgraph.distributed import ordered_index
from tabgraph.operators import joins, lists, rows, sampling
from tabgraph.plans.features import customer_features, fill_missing, n_unique
from tabgraph.plans.sampler import draw_samples
from tabgraph.sources import adapters as src
from tabgraph.sources import tables

FEATURE_SQL = f"""
with {FACT}, {PRODUCT}, {TRAIN},
matched as (
  select t.customer_id, t."timestamp", t.churn, f.*  exclude (customer_id), p.* exclude (product_id)
  from train t join fact f on f.customer_id = t.customer_id
    and f.review_time < t."timestamp" and f.review_time >= t."timestamp" - interval 6 month
  left join product p on p.product_id = f.product_id),
grouped as (
  select customer_id, "timestamp", churn, count(*) as num_reviews,
    count(distinct product_id) as num_unique_products,
    avg(rating) as avg_rating, stddev_samp(rating) as std_rating,
    min(rating) as min_rating, max(rating) as max_rating,
    count(*) filter (verified) as num_verified_purchases,
    count(distinct category) as num_unique_categories,
    count(distinct brand) as num_unique_brands,
    avg(price) as avg_product_price, stddev_samp(price) as std_product_price,
    min(price) as min_product_price, max(price) as max_product_price,
    date_sub('day', max(review_time), "timestamp") as days_since_last_review,
    date_sub('day', min(review_time), "timestamp") as days_since_first_review
  from matched group by customer_id, "timestamp", churn)
"""
FEATURE_SELECT = """
select t."timestamp", t.customer_id, t.churn,
  coalesce(num_reviews, 0) as num_reviews,
  coalesce(num_unique_products, 0) as num_unique_products,
  round(coalesce(avg_rating, 0), 6) as avg_rating,
  round(coalesce(std_rating, 0), 6) as std_rating,
  coalesce(min_rating, 0) as min_rating, coalesce(max_rating, 0) as max_rating,
  coalesce(num_verified_purchases, 0) as num_verified_purchases,
  coalesce(num_unique_categories, 0) as num_unique_categories,
  coalesce(num_unique_brands, 0) as num_unique_brands,
  round(coalesce(avg_product_price, 0), 6) as avg_product_price,
  round(coalesce(std_product_price, 0), 6) as std_product_price,
  round(coalesce(min_product_price, 0), 6) as min_product_price,
  round(coalesce(max_product_price, 0), 6) as max_product_price,
  coalesce(days_since_last_review, 0) as days_since_last_review,
  coalesce(days_since_first_review, 0) as days_since_first_review,
  round(coalesce(num_reviews / (days_since_first_review / 30.0 + 1e-6), 0), 6) as review_frequency
from train t left join grouped g on g.customer_id = t.customer_id
  and g."timestamp" = t."timestamp" and g.churn = t.churn
"""


@query("a9_feature_frame", FEATURE_SQL + FEATURE_SELECT)
def a9_feature_frame(spark, sf_dir):
    return rounded(customer_features(
        src.train(spark, sf_dir), src.fact(spark, sf_dir), src.product(spark, sf_dir), "-6mo"
    ))


# --- rows -------------------------------------------------------------------

LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
              "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
              "l_shipdate"]


@query("p1_ordered_index", f"""
select row_number() over (order by {', '.join(LINE_ORDER)}) - 1 as row_id,
  l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate from lineitem""")
def p1_ordered_index(spark, sf_dir):
    lines = src.table(spark, sf_dir, "lineitem")
    return ordered_index(lines, LINE_ORDER, "row_id").select(
        "row_id", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate")


@query("p2_select_rename", "select p_partkey as product_id, p_retailprice as price from part")
def p2_select_rename(spark, sf_dir):
    return src.product(spark, sf_dir).select("product_id", "price")


@query("p3_year_filter", """
select o_orderkey, o_custkey, o_orderdate from orders where year(o_orderdate) = 1997""")
def p3_year_filter(spark, sf_dir):
    orders = src.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return rows.year_filter(orders, "o_orderdate", 1997)


@query("p4_isin_filter", """
select o_orderkey, o_custkey from orders where o_custkey in
  (select c_custkey from customer where c_mktsegment = 'BUILDING')""")
def p4_isin_filter(spark, sf_dir):
    ids = src.table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    orders = src.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return rows.isin_filter(orders, ids.select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"])


@query("p5_not_null_filter", f"""
with {TRAIN} select "timestamp", customer_id, churn from train t where exists
  (select 1 from orders where o_custkey = customer_id and o_orderdate <= t."timestamp")""")
def p5_not_null_filter(spark, sf_dir):
    orders = _customer_orders(spark, sf_dir)
    joined = joins.asof_join(src.train(spark, sf_dir), orders, ["customer_id"], "timestamp", "review_time")
    return rows.not_null_filter(joined, "review_time").select("timestamp", "customer_id", "churn")


def _customer_orders(spark, sf_dir):
    return src.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("review_time"),
        "o_orderkey", "o_totalprice")


@query("p6_window_predicate", f"""
with {TRAIN} select "timestamp", customer_id, o_orderkey from train t join orders
  on o_custkey = customer_id and o_orderdate < t."timestamp"
  and o_orderdate >= t."timestamp" - interval 18 month""")
def p6_window_predicate(spark, sf_dir):
    matched = joins.window_join(
        src.train(spark, sf_dir), _customer_orders(spark, sf_dir), "customer_id", "timestamp",
        "review_time", "-1y6mo")
    return matched.select("timestamp", "customer_id", "o_orderkey")


@query("p7_label_rows", f"""
with {TRAIN} select "timestamp", customer_id from train where churn = 1""")
def p7_label_rows(spark, sf_dir):
    return rows.label_rows(src.train(spark, sf_dir), "churn", 1).select("timestamp", "customer_id")


@query("p8_fill_missing", """
select l_orderkey, l_linenumber, count(*) as n,
  round(coalesce(stddev_samp(l_quantity), 0), 6) as std_quantity
from lineitem group by l_orderkey, l_linenumber""")
def p8_fill_missing(spark, sf_dir):
    lines = src.table(spark, sf_dir, "lineitem")
    spread = lines.groupBy("l_orderkey", "l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp("l_quantity").alias("std_quantity"))
    return rounded(fill_missing(spread))


@query("p9_label_years", f"""
with {TRAIN} select unnest(range(min(year("timestamp")), max(year("timestamp")) + 1)) as year
from train""")
def p9_label_years(spark, sf_dir):
    return rows.label_years(src.train(spark, sf_dir), "timestamp").select(F.col("year").cast("long"))


@query("p10_alignment_report", """
select count(c_custkey) as rows_left, count(s_suppkey) as rows_right,
  count(*) filter (c_nationkey is distinct from s_nationkey) as mismatches
from customer full join supplier on c_custkey = s_suppkey""")
def p10_alignment_report(spark, sf_dir):
    left = src.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("row_id"), F.col("c_nationkey").alias("nation"))
    right = src.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("row_id"), F.col("s_nationkey").alias("nation"))
    return rows.alignment_report(left, right, "row_id", "nation")


# --- joins ------------------------------------------------------------------

@query("j1_left_join", f"""
with {TRAIN} select t."timestamp", t.customer_id, count(o_orderkey) as n_orders
from train t left join orders on o_custkey = customer_id group by 1, 2""")
def j1_left_join(spark, sf_dir):
    # Orders combine to one row per customer before they meet the training rows.
    orders = _customer_orders(spark, sf_dir).groupBy("customer_id").agg(
        F.count("o_orderkey").alias("n_orders"))
    joined = joins.attach(src.train(spark, sf_dir), orders, ["customer_id"])
    return joined.select("timestamp", "customer_id", F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


@query("j2_enrich", f"""
with {FACT}, {PRODUCT} select review_id, customer_id, product_id, price, category, brand
from fact left join product using (product_id)""")
def j2_enrich(spark, sf_dir):
    facts = src.fact(spark, sf_dir, with_id=True).select("review_id", "customer_id", "product_id")
    return joins.enrich(facts, src.product(spark, sf_dir), "product_id", ["price", "category", "brand"])


J3_MATCHED = f"""
with {FACT}, {TRAIN}, matched as (
  select t.customer_id, t."timestamp", f.product_id, f.review_time, f.rating
  from train t join fact f on f.customer_id = t.customer_id
    and f.review_time < t."timestamp" and f.review_time >= t."timestamp" - interval 6 month)
"""


@query("j3_window_join", J3_MATCHED + "select * from matched")
def j3_window_join(spark, sf_dir):
    facts = src.fact(spark, sf_dir).select("customer_id", "product_id", "review_time", "rating")
    matched = joins.window_join(
        src.train(spark, sf_dir), facts, "customer_id", "timestamp", "review_time", "-6mo")
    return matched.select("customer_id", "timestamp", "product_id", "review_time", "rating")


@query("j3_window_join_left", J3_MATCHED + """
select t.node_id, t.customer_id, m.product_id, m.rating from train t left join matched m
  on m.customer_id = t.customer_id and m."timestamp" = t."timestamp" """)
def j3_window_join_left(spark, sf_dir):
    facts = src.fact(spark, sf_dir).select("customer_id", "product_id", "review_time", "rating")
    joined = joins.window_join_left(
        src.train(spark, sf_dir, with_id=True), facts, "customer_id", "timestamp", "review_time",
        "-6mo", "node_id")
    return joined.select("node_id", "customer_id", "product_id", "rating")


@query("j4_asof_join", """
select l.event_id, l.user_id, max(r.ts) as click_ts, arg_max(r.event_id, r.ts) as click_id
from events l left join events r on r.user_id = l.user_id and r.event_type = 'click' and r.ts <= l.ts
where l.event_type = 'error' group by all""")
def j4_asof_join(spark, sf_dir):
    events = src.table(spark, sf_dir, "events")
    errors = events.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    clicks = events.filter("event_type = 'click'").select(
        "user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"))
    return joins.asof_join(errors, clicks, ["user_id"], "ts", "click_ts").drop("ts")


@query("j4_asof_null_keys", """
with e as (select event_id, nullif(user_id, user_id // 7 * 7) as user_id, ts, event_type from events)
select l.event_id, l.user_id, max(r.ts) as click_ts
from e l left join e r on r.user_id = l.user_id and r.event_type = 'click' and r.ts <= l.ts
where l.event_type = 'error' group by all""")
def j4_asof_null_keys(spark, sf_dir):
    user = F.when(F.col("user_id") % 7 != 0, F.col("user_id"))
    events = src.table(spark, sf_dir, "events").withColumn("user_id", user)
    errors = events.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    clicks = events.filter("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"))
    return joins.asof_join(errors, clicks, ["user_id"], "ts", "click_ts").drop("ts")


@query("j5_window_exists", """
select l.event_id from events l where l.event_type = 'error' and exists (select 1 from events r
  where r.user_id = l.user_id and r.event_type = 'click' and r.ts <= l.ts
    and r.ts >= l.ts - interval 12 hour)""")
def j5_window_exists(spark, sf_dir):
    events = src.table(spark, sf_dir, "events")
    errors = events.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    clicks = events.filter("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"))
    return joins.window_exists(errors, clicks, ["user_id"], "ts", "click_ts", "12h").select("event_id")


@query("j6_attach", J3_MATCHED + """
, g as (select customer_id, "timestamp", count(*) as n from matched group by all)
select t.node_id, t.customer_id, g.n from train t left join g
  on g.customer_id = t.customer_id and g."timestamp" = t."timestamp" """)
def j6_attach(spark, sf_dir):
    base = src.train(spark, sf_dir, with_id=True)
    facts = src.fact(spark, sf_dir).select("customer_id", "review_time")
    matched = joins.window_join(base, facts, "customer_id", "timestamp", "review_time", "-6mo")
    counts = matched.groupBy("customer_id", "timestamp").agg(F.count(F.lit(1)).alias("n"))
    return joins.attach(base, counts, ["customer_id", "timestamp"]).select("node_id", "customer_id", "n")


LISTS_SQL = f"""
with {FACT}, {PRODUCT}, {TRAIN}, matched as (
  select t.node_id, f.product_id, f.review_id, f.review_time, f.rating
  from train t join fact f on f.customer_id = t.customer_id
    and f.review_time < t."timestamp" and f.review_time >= t."timestamp" - interval 6 month)
"""


def _product_lists(spark, sf_dir):
    return lists.key_lists(
        src.train(spark, sf_dir, with_id=True), src.fact(spark, sf_dir), "customer_id",
        "product_id", "timestamp", "review_time", "-6mo", ["review_time", "product_id"])


@query("a7_key_lists", LISTS_SQL + """
select t.node_id, coalesce(string_agg(product_id, ',' order by review_time, product_id), '')
  as product_ids, count(product_id) as n_items
from train t left join matched m on m.node_id = t.node_id group by t.node_id""")
def a7_key_lists(spark, sf_dir):
    return _product_lists(spark, sf_dir).select(
        "node_id",
        F.array_join(F.col("product_id").cast("array<string>"), ",").alias("product_ids"),
        F.size("product_id").cast("long").alias("n_items"))


@query("j7_expand_columns", LISTS_SQL + """
select t.node_id,
  coalesce(string_agg(coalesce(brand, '~'), ',' order by review_time, m.product_id), '~') as brands,
  coalesce(string_agg(coalesce(title, '~'), ',' order by review_time, m.product_id), '~') as titles,
  coalesce(string_agg(coalesce(category, '~'), ',' order by review_time, m.product_id), '~') as categories,
  coalesce(round(sum(price), 4), 0) as price_total, greatest(count(m.product_id), 1) as n_items
from train t left join matched m on m.node_id = t.node_id
left join product p on p.product_id = m.product_id group by t.node_id""")
def j7_expand_columns(spark, sf_dir):
    cells = lists.expand_columns(
        _product_lists(spark, sf_dir), src.product(spark, sf_dir), "product_id",
        ["title", "brand", "price", "category"], "product")
    known = F.filter("product_price", lambda p: p.isNotNull())
    return cells.select(
        "node_id",
        F.array_join("product_brand", ",", "~").alias("brands"),
        F.array_join("product_title", ",", "~").alias("titles"),
        F.array_join("product_category", ",", "~").alias("categories"),
        F.round(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), 4).alias("price_total"),
        F.size("product_price").cast("long").alias("n_items"))


@query("j7_expand_reviews", LISTS_SQL + """
select t.node_id,
  coalesce(string_agg(m.review_id, ',' order by review_time, m.review_id), '') as review_ids,
  coalesce(string_agg(cast(rating as bigint), ',' order by review_time, m.review_id), '~') as ratings
from train t left join matched m on m.node_id = t.node_id group by t.node_id""")
def j7_expand_reviews(spark, sf_dir):
    facts = src.fact(spark, sf_dir, with_id=True)
    cells = lists.key_lists(
        src.train(spark, sf_dir, with_id=True), facts, "customer_id", "review_id", "timestamp",
        "review_time", "-6mo", ["review_time", "review_id"])
    cells = lists.expand_columns(cells, facts, "review_id", ["rating"], "review")
    as_text = F.transform("review_rating", lambda r: r.cast("long").cast("string"))
    return cells.select(
        "node_id",
        F.array_join(F.col("review_id").cast("array<string>"), ",").alias("review_ids"),
        F.array_join(as_text, ",", "~").alias("ratings"))


@query("j8_self_pairs", """
select a.s_suppkey as src, b.s_suppkey as dst from supplier a join supplier b
  on a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey""")
def j8_self_pairs(spark, sf_dir):
    nodes = src.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node_id"), "s_nationkey")
    return joins.self_pairs(nodes, ["s_nationkey"])


# --- aggregates -------------------------------------------------------------

@query("a1_a6_group_aggregates", f"""
with {FACT}, {PRODUCT} select customer_id, count(*) as n,
  count(distinct nullif(brand, 'Brand#2')) + max(cast(brand = 'Brand#2' as int)) as n_brands,
  round(avg(rating), 6) as avg_rating, round(stddev_samp(rating), 6) as std_rating,
  min(rating) as min_rating, max(rating) as max_rating, min(review_time) as first_time,
  max(review_time) as last_time, count(*) filter (verified) as n_verified
from fact join product using (product_id) group by customer_id""")
def a1_a6_group_aggregates(spark, sf_dir):
    products = src.product(spark, sf_dir).withColumn("brand", F.expr("nullif(brand, 'Brand#2')"))
    reviews = joins.enrich(src.fact(spark, sf_dir), products, "product_id", ["brand"])
    return rounded(reviews.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n"), n_unique("brand").alias("n_brands"),
        F.avg("rating").alias("avg_rating"), F.stddev_samp("rating").alias("std_rating"),
        F.min("rating").alias("min_rating"), F.max("rating").alias("max_rating"),
        F.min("review_time").alias("first_time"), F.max("review_time").alias("last_time"),
        F.count_if("verified").alias("n_verified")))


@query("a8_implode", """
select n_regionkey as region, string_agg(case when n_nationkey % 3 = 0 then '~' else n_name end, ','
  order by n_nationkey) as names from nation group by n_regionkey""")
def a8_implode(spark, sf_dir):
    nations = src.table(spark, sf_dir, "nation").withColumn(
        "name", F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")))
    packed = nations.groupBy(F.col("n_regionkey").alias("region")).agg(
        lists.implode(["n_nationkey"], ["name"]).alias("cell"))
    return packed.select("region", F.array_join(F.transform("cell", lambda s: s["name"]), ",", "~").alias("names"))


@query("a10_value_counts", LISTS_SQL + """
select node_id, brand as item, count(*) as weight from matched join product using (product_id)
group by node_id, brand""")
def a10_value_counts(spark, sf_dir):
    return lists.value_counts(_window_brands(spark, sf_dir), "node_id", "item")


def _window_brands(spark, sf_dir):
    """Long form: the brands each training row bought inside its window."""
    items = lists.window_items(
        src.train(spark, sf_dir, with_id=True), src.fact(spark, sf_dir), "customer_id",
        ["product_id"], "timestamp", "review_time", "-6mo")
    brands = src.product(spark, sf_dir).select("product_id", F.col("brand").alias("item"))
    return items.join(brands, "product_id", "left").select("node_id", "item")


@query("a12_global_range", "select min(c_acctbal) as lo, max(c_acctbal) as hi from customer")
def a12_global_range(spark, sf_dir):
    return rows.global_range(src.table(spark, sf_dir, "customer"), "c_acctbal")


@query("a13_distinct_labels", "select distinct label from embeddings")
def a13_distinct_labels(spark, sf_dir):
    return rows.distinct_labels(src.table(spark, sf_dir, "embeddings"), "label")


@query("a14_describe", """
with long as (select 'c_acctbal' as "column", c_acctbal as v from customer
  union all select 'c_nationkey', cast(c_nationkey as double) from customer)
select "column", count(v) as "count", round(avg(v), 6) as mean, round(stddev_samp(v), 6) as std,
  min(v) as min, round(quantile_cont(v, 0.25), 6) as q25, round(quantile_cont(v, 0.5), 6) as q50,
  round(quantile_cont(v, 0.75), 6) as q75, max(v) as max from long group by "column" """)
def a14_describe(spark, sf_dir):
    return rounded(rows.describe(src.table(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey"]))


@query("a15_count_statistics", f"""
with {FACT}, c as (select c_custkey, count(customer_id) as n from customer left join fact on customer_id = c_custkey group by 1)
select count(*) as n_nodes, min(n) as min_count, max(n) as max_count,
  round(avg(n), 6) as mean_count from c""")
def a15_count_statistics(spark, sf_dir):
    """Reviews per customer, customers without any included."""
    reviews = src.fact(spark, sf_dir).groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
    customers = src.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"))
    return rounded(rows.count_statistics(customers.join(reviews, "customer_id", "left").fillna(0, ["n"]), "n"))


# --- top-k, unions ----------------------------------------------------------

TOP_SQL = """top as (
  select year, product_id, count, rank from (
    select *, row_number() over (partition by year order by count desc, product_id) as rank
    from (select year(review_time) as year, product_id, count(*) as count from fact group by 1, 2))
  where rank <= {k})"""


@query("w1_top_k_per_year", f"with {FACT}, {TOP_SQL.format(k=50)} select * from top")
def w1_top_k_per_year(spark, sf_dir):
    return rows.top_k_per_year(src.fact(spark, sf_dir), "product_id", "review_time", 50)


@query("w2_latest_n", f"""
with {TRAIN}, kept as (select "timestamp", customer_id, churn from train
  order by "timestamp" desc, customer_id desc limit 700)
select row_number() over (order by "timestamp", customer_id) - 1 as node_id, * from kept""")
def w2_latest_n(spark, sf_dir):
    return rows.latest_n(src.train(spark, sf_dir), 700, "timestamp", ["customer_id"])


@query("w3_sorted_rows", "select c_custkey, c_acctbal from customer order by c_acctbal, c_custkey")
def w3_sorted_rows(spark, sf_dir):
    return src.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").orderBy("c_acctbal", "c_custkey")


@query("w6_preview", "select o_orderkey, o_custkey, o_orderdate from orders order by o_orderkey limit 50")
def w6_preview(spark, sf_dir):
    orders = src.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return tables.preview(orders, ["o_orderkey"])


@query("s6_shape", "select count(*) as total_rows, cast(6 as bigint) as total_columns from orders")
def s6_shape(spark, sf_dir):
    return tables.shape_of(src.table(spark, sf_dir, "orders"))


@query("u1_union_all", """
select c_custkey as id, c_nationkey as nation from customer
union all select s_suppkey, s_nationkey from supplier""")
def u1_union_all(spark, sf_dir):
    customers = src.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    suppliers = src.table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"))
    return rows.union_all([customers, suppliers])


# --- sampling and splits ----------------------------------------------------

DRAW = """md5('{seed}|' || customer_id || '|' || cast("timestamp" as varchar))"""


@query("r1_sample_n", f"""
with {TRAIN} select "timestamp", customer_id, churn, row_number() over (order by
  {DRAW.format(seed=123)}) - 1 as draw_no from train
qualify draw_no < 5000""")
def r1_sample_n(spark, sf_dir):
    return sampling.sample_n(src.train(spark, sf_dir), 5000, ["customer_id", "timestamp"])


QUOTA_SQL = """quota as (
  select 1 as churn, least({t1} + case when h1 < {t1} then 0 else greatest({t0} - h0, 0) end, h1) as q
    from have
  union all select 0, least({t0} + greatest({t1} - h1, 0), h0) from have)"""


def _stratified_sql(pool: str, n: int, ratio: float, n_files: int, ctes: str) -> str:
    t1 = int(n * ratio)
    return f"""
with {ctes}, have as (select count(*) filter (churn = 1) as h1,
    count(*) filter (churn = 0) as h0 from {pool}),
{QUOTA_SQL.format(t1=t1, t0=n - t1)},
draws as (select p."timestamp", p.customer_id, p.churn, i as sample_no,
    row_number() over (partition by i, p.churn order by md5((123 + i) || '|' || customer_id || '|'
      || cast("timestamp" as varchar))) - 1 as draw_no
  from {pool} p cross join range({n_files}) r(i))
select d.* from draws d join quota using (churn) where draw_no < q"""


@query("r2_sample_stratified", _stratified_sql("train", 9000, 0.4, 1, TRAIN))
def r2_sample_stratified(spark, sf_dir):
    drawn = sampling.sample_stratified(
        src.train(spark, sf_dir), 9000, 0.4, ["customer_id", "timestamp"])
    return drawn.withColumn("sample_no", F.col("sample_no").cast("long"))


@query("r3_sample_repeated", f"""
with {TRAIN} select "timestamp", customer_id, churn, i as sample_no, row_number() over (
  partition by i order by md5((123 + i) || '|' || customer_id || '|' || cast("timestamp" as varchar)))
  - 1 as draw_no from train cross join range(3) r(i) qualify draw_no < 1000""")
def r3_sample_repeated(spark, sf_dir):
    drawn = sampling.sample_repeated(
        src.train(spark, sf_dir), 1000, 3, ["customer_id", "timestamp"])
    return drawn.withColumn("sample_no", F.col("sample_no").cast("long"))


POOL_SQL = f"""{FACT}, {TRAIN}, {TOP_SQL.format(k=200)}, pool as (
  select "timestamp", customer_id, churn from train t where exists (
    select 1 from fact f join top on top.product_id = f.product_id
    where f.customer_id = t.customer_id and top.year = year(t."timestamp")
      and f.review_time <= t."timestamp" and f.review_time >= t."timestamp" - interval 6 month))"""


@query("r4_sampler", _stratified_sql("pool", 2000, 0.6, 2, POOL_SQL))
def r4_sampler(spark, sf_dir):
    drawn = draw_samples(
        src.train(spark, sf_dir), src.fact(spark, sf_dir), top_k=200, time_window="6mo",
        sample_size=2000, n_files=2, churn_ratio=0.6)
    return drawn.withColumn("sample_no", F.col("sample_no").cast("long"))


SPLIT_SQL = """case when {rank} < floor(n * 0.8::double) then 'train'
  when {rank} < floor(n * 0.8::double) + floor(n * 0.1::double) then 'val' else 'test' end as split"""


@query("m1_split_rowwise", f"""
with {TRAIN} select node_id, {SPLIT_SQL.format(rank='node_id')}
from train, (select count(*) as n from train)""")
def m1_split_rowwise(spark, sf_dir):
    return sampling.split_rowwise(src.train(spark, sf_dir, with_id=True)).select("node_id", "split")


@query("m2_split_temporal", f"""
with ranked as (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 as rank,
  count(*) over () as n from orders)
select o_orderkey, {SPLIT_SQL.format(rank='rank')} from ranked""")
def m2_split_temporal(spark, sf_dir):
    orders = src.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return sampling.split_temporal(orders, "o_orderdate", "o_orderkey").select("o_orderkey", "split")


M3_SQL = """
size as (select label, count(*) as size from embeddings group by label),
t as (select *, sum(size) over () as n, ceil(sum(size) over () * (1 - 0.8::double)) as tmp from size),
t2 as (select *, ceil(tmp * (1 - 0.1::double / (1 - 0.8::double))) as test from t),
a as (select *, size / n::double * (n - tmp) as share from t2),
b as (select *, floor(share) + case when row_number() over (order by share - floor(share) desc, label)
  <= (n - tmp) - sum(floor(share)) over () then 1 else 0 end as n_train from a),
c as (select *, (size - n_train) / tmp * (tmp - test) as share2 from b),
d as (select *, floor(share2) + case when row_number() over (order by share2 - floor(share2) desc, label)
  <= (tmp - test) - sum(floor(share2)) over () then 1 else 0 end as n_val from c)"""


@query("m3_split_stratified", f"""
with {M3_SQL}, r as (select vec_id, label, row_number() over (partition by label
    order by md5('123|' || vec_id)) - 1 as rank from embeddings)
select vec_id, label, case when rank < n_train then 'train' when rank < n_train + n_val then 'val'
  else 'test' end as split from r join d using (label)""")
def m3_split_stratified(spark, sf_dir):
    nodes = src.table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return sampling.split_stratified(nodes, "label", "vec_id").select("vec_id", "label", "split")
