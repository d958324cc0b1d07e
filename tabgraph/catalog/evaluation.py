"""Scalar functions, evaluation and classifiers over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabgraph.catalog.registry import TRAIN, query
from tabgraph.catalog.rounding import r6, rounded
from tabgraph.catalog.relational import FEATURE_SQL
from tabgraph.catalog.similarities import CUSTOMERS, _vector_graph, customer_counts, vectors
from tabgraph.distributed import with_scalars
from tabgraph.functions import dates, numbers, text, timewin
from tabgraph.operators import evaluate, graph, learn, propagate, sampling
from tabgraph.operators import similarity as sim
from tabgraph.plans import experiment, registry
from tabgraph.plans.features import customer_features
from tabgraph.sources import adapters as src

# --- text -------------------------------------------------------------------


@query("t1_clean_author", """
select p_partkey, case when p_partkey % 2 = 0 then trim(p_name) else p_brand end as author from part""")
def t1_clean_author(spark, sf_dir):
    wrapped = F.concat(F.lit("  visit amazon's   "), "p_name", F.lit("  PAGE "))
    raw = F.when(F.col("p_partkey") % 2 == 0, wrapped).otherwise(F.concat(F.lit(" "), "p_brand", F.lit(" ")))
    return src.table(spark, sf_dir, "part").select("p_partkey", text.clean_author(raw).alias("author"))


@query("t2_clean_author_list", "select p_partkey, p_name || '|' || p_brand as authors from part")
def t2_clean_author_list(spark, sf_dir):
    wrapped = F.concat(F.lit("Visit Amazon's "), "p_name", F.lit(" Page"))
    cells = F.array(wrapped, F.lit(""), F.lit(None), F.col("p_brand"))
    return src.table(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(text.clean_author_list(cells), "|").alias("authors"))


@query("t3_flatten_and_filter", """
select p_partkey as product_id, p_type || ' & more|' || replace(p_name, ' ', '|') as categories from part""")
def t3_flatten_and_filter(spark, sf_dir):
    marked = F.array(F.array(F.lit(" BOOKS "), F.concat("category", F.lit(" &amp; more")), F.lit("  ")),
                     F.element_at("category_tree", 2))
    return src.product(spark, sf_dir).select(
        "product_id", F.array_join(text.flatten_and_filter(marked), "|").alias("categories"))


# Every entity found in the pages; the ampersand comes last.
ENTITIES = """replace(replace(replace(replace({0}, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&')"""


@query("t4_clean_html", f"""
select page_id, trim(regexp_replace(regexp_replace({ENTITIES.format('html')}, '<[^>]+>', '', 'g'),
  '\\s+', ' ', 'g')) as text from pages""")
def t4_clean_html(spark, sf_dir):
    return src.table(spark, sf_dir, "pages").select("page_id", text.clean_html(F.col("html")).alias("text"))


@query("t5_html_unescape", f"select page_id, {ENTITIES.format('html')} as html from pages")
def t5_html_unescape(spark, sf_dir):
    return src.table(spark, sf_dir, "pages").select("page_id", text.html_unescape("html").alias("html"))


@query("t6_parse_string_list", "select p_partkey, p_name || '|' || p_brand || '|x' as items from part")
def t6_parse_string_list(spark, sf_dir):
    cell = F.concat(F.lit("['"), "p_name", F.lit("' \""), "p_brand", F.lit("\" x]"))
    return src.table(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(text.parse_string_list(cell), "|").alias("items"))


@query("t7_join_text_list", """
select conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) as text from conversations""")
def t7_join_text_list(spark, sf_dir):
    cells = F.split("text", "\n")
    return src.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", text.join_text_list(cells).alias("text"))


@query("t8_format_cell", """
select doc_id, case when length(text) > 80 then substr(text, 1, 77) || '...' else text end as line,
  array_to_string(list_filter(string_split(source || '//' || lang, '/'), lambda s: trim(s) <> ''), ' | ') as parts
from documents""")
def t8_format_cell(spark, sf_dir):
    parts = F.split(F.concat("source", F.lit("//"), "lang"), "/")
    return src.table(spark, sf_dir, "documents").select(
        "doc_id", text.format_cell(F.col("text"), False, 80).alias("line"),
        text.format_cell(parts, True, 80).alias("parts"))


# --- time -------------------------------------------------------------------


@query("t9_offset_by", """
select o_orderkey, o_orderdate - interval 6 month as half_year, o_orderdate - interval 18 month as longer,
  o_orderdate + interval 3 month as ahead, o_orderdate - interval 36 hour as hours from orders""")
def t9_offset_by(spark, sf_dir):
    day = F.col("o_orderdate")
    return src.table(spark, sf_dir, "orders").select(
        "o_orderkey", timewin.offset_by(day, "-6mo").alias("half_year"),
        timewin.offset_by(day, "-1y6mo").alias("longer"), timewin.offset_by(day, "1q").alias("ahead"),
        timewin.offset_by(day, "-1d12h").alias("hours"))


@query("t10_t11_year_total_days", """
select event_id, year(ts) as year, date_sub('day', ts, timestamp '2024-02-01 12:00:00') as days from events""")
def t10_t11_year_total_days(spark, sf_dir):
    later = F.lit("2024-02-01 12:00:00").cast("timestamp_ntz")
    return src.table(spark, sf_dir, "events").select(
        "event_id", F.year("ts").cast("long").alias("year"), timewin.total_days(later, F.col("ts")).alias("days"))


@query("t12_to_date_list", """
select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ',' || strftime(o_orderdate + interval 1 day, '%Y-%m-%d')
  as dates from orders""")
def t12_to_date_list(spark, sf_dir):
    day = F.col("o_orderdate")
    cells = F.array(day.cast("string"), F.lit("no date"), F.lit(None),
                    timewin.offset_by(day, "1d").cast("date").cast("string"))
    found = F.transform(dates.to_date_list(cells), lambda d: d.cast("string"))
    return src.table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(found, ",").alias("dates"))


# --- numbers ----------------------------------------------------------------


@query("t14_minmax_scale", """
select c_custkey, round((c_acctbal - min(c_acctbal) over ()) / (max(c_acctbal) over () - min(c_acctbal) over ()), 6)
  as scaled from customer""")
def t14_minmax_scale(spark, sf_dir):
    customers = src.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return rounded(numbers.minmax_scale(customers, "c_acctbal", "scaled").drop("c_acctbal"))


@query("t15_standard_scale", """
with s as (select avg(c_acctbal) as m, stddev_pop(c_acctbal) as d, avg(c_nationkey) as m2,
  stddev_pop(c_nationkey) as d2 from customer where c_mktsegment <> 'BUILDING')
select c_custkey, round((c_acctbal - m) / d, 6) as balance, round((c_nationkey - m2) / d2, 6) as nation,
  0.0::double as same from customer, s""")
def t15_standard_scale(spark, sf_dir):
    customers = src.table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"),
        F.lit(0.1).alias("same"), "c_mktsegment")
    scaled = numbers.standard_scale(customers, ["balance", "nation", "same"], F.col("c_mktsegment") != "BUILDING")
    return rounded(scaled.drop("c_mktsegment"))


@query("t18_stable_key", """
select c_custkey, coalesce('=' || nullif(c_mktsegment, 'BUILDING'), 'missing') as key from customer""")
def t18_stable_key(spark, sf_dir):
    nodes = customer_counts(spark, sf_dir)
    key = numbers.stable_key(F.col("segment"), nodes.schema["segment"].dataType)
    return nodes.select(F.col("node_id").alias("c_custkey"), key.alias("key"))


@query("t19_remap_labels", """
select doc_id, (dense_rank() over (order by lang) - 1)::int as lang from documents""")
def t19_remap_labels(spark, sf_dir):
    documents = src.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return numbers.remap_labels(documents, "lang", 4)


@query("t20_scores", """
with s as (select vec_id, embedding::double[] as v from embeddings)
select vec_id, round(1 / (1 + exp(-v[1])), 6) as sigmoid,
  round(exp(v[2]) / list_sum([exp(x) for x in v]), 6) as softmax_1,
  (list_position(v, list_max(v)) - 1)::int as argmax from s""")
def t20_scores(spark, sf_dir):
    whole = F.transform("embedding", lambda x: x.cast("double"))
    rows = src.table(spark, sf_dir, "embeddings").select("vec_id", whole.alias("v"))
    return rounded(rows.select(
        "vec_id", numbers.sigmoid(F.element_at("v", 1)).alias("sigmoid"),
        F.element_at(numbers.softmax(F.col("v")), 2).alias("softmax_1"),
        numbers.argmax(F.col("v")).alias("argmax")))


@query("t21_l2_normalize", """
with s as (select vec_id, pos, embedding[pos]::double as x from embeddings, range(1, 65) r(pos))
select vec_id, pos, round(2 * x / sqrt(sum(4 * x * x) over (partition by vec_id)), 6) + 0.0 as x from s""")
def t21_l2_normalize(spark, sf_dir):
    doubled = F.transform("embedding", lambda x: x.cast("double") * 2)
    units = src.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.posexplode(numbers.l2_normalize(doubled)).alias("pos", "x"))
    return units.select("vec_id", (F.col("pos") + 1).cast("long").alias("pos"), r6("x").alias("x"))


# --- evaluation -------------------------------------------------------------

SCORED = f"""{FEATURE_SQL.strip()[4:]}, scored as (
  select t.churn as y, 1 / (1 + exp((coalesce(num_reviews, 0) - 3) / 4.0)) as p,
    case when node_id < floor(n * 0.8::double) then 'train'
      when node_id < floor(n * 0.8::double) + floor(n * 0.1::double) then 'val' else 'test' end as split
  from train t left join grouped g on g.customer_id = t.customer_id and g."timestamp" = t."timestamp"
    and g.churn = t.churn, (select count(*) as n from train))"""


def scored_rows(spark, sf_dir):
    """Training rows scored by their review count: few reviews, likely churn."""
    rows = customer_features(
        src.train(spark, sf_dir, with_id=True), src.fact(spark, sf_dir), src.product(spark, sf_dir))
    p = numbers.sigmoid(-(F.col("num_reviews") - 3) / F.lit(4.0))
    return sampling.split_rowwise(rows).select("split", F.col("churn").alias("y"), p.alias("p"))


def _judged(spark, sf_dir):
    return scored_rows(spark, sf_dir).withColumn("pred", (F.col("p") > 0.5).cast("int"))


JUDGED = f"with {SCORED}, judged as (select *, (p > 0.5)::int as pred from scored)"
AUC_SQL = """select split, (sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg))) as auroc
  from (select *, sum(neg) over (partition by split order by p rows unbounded preceding) - neg as below
    from (select split, p, count(*) filter (y = 1) as pos, count(*) filter (y <> 1) as neg from {0} group by 1, 2))
  group by split"""


@query("e1_accuracy", f"{JUDGED} select split, round(avg((y = pred)::int), 6) as accuracy from judged group by 1")
def e1_accuracy(spark, sf_dir):
    return rounded(evaluate.accuracy(_judged(spark, sf_dir)))


@query("e2_confusion_matrix", f"""{JUDGED} select split, a.y as y, b.pred as pred,
  (select count(*) from judged j where j.split = s.split and j.y = a.y and j.pred = b.pred) as n
from (select distinct split from judged) s, (values (0), (1)) a(y), (values (0), (1)) b(pred)""")
def e2_confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(_judged(spark, sf_dir))


@query("e3_f1_binary", f"""{JUDGED} select split, round(2.0 * count(*) filter (y = 1 and pred = 1)
  / (count(*) filter (y = 1) + count(*) filter (pred = 1)), 6) as f1 from judged group by 1""")
def e3_f1_binary(spark, sf_dir):
    return rounded(evaluate.f1_binary(_judged(spark, sf_dir)))


@query("e5_auroc", f"with {SCORED} select split, round(auroc, 6) as auroc from ({AUC_SQL.format('scored')})")
def e5_auroc(spark, sf_dir):
    return rounded(evaluate.auroc(scored_rows(spark, sf_dir)))


E7_SQL = """thr as (select i as no, 0.01::double + (i - 1) * (0.98::double / 98) as t from range(1, 100) r(i)),
f as (select no, t, 2.0 * count(*) filter (y = 1 and p >= t)
  / (2 * count(*) filter (y = 1 and p >= t) + count(*) filter (y <> 1 and p >= t) + count(*) filter (y = 1 and p < t))
  as f1 from thr, (select * from scored where split = 'val') group by 1, 2),
best as (select t as threshold, f1 from f order by f1 desc, no limit 1)"""


@query("e7_best_threshold", f"""with {SCORED}, {E7_SQL}
select round(threshold, 6) as threshold, round(f1, 6) as f1 from best""")
def e7_best_threshold(spark, sf_dir):
    return rounded(evaluate.best_threshold(scored_rows(spark, sf_dir).filter("split = 'val'")))


@query("e8_classification_report", f"""{JUDGED},
c as (select split, label, count(*) filter (y = label and pred = label) as tp,
    count(*) filter (pred = label) as said, count(*) filter (y = label) as support
  from judged, (values (0), (1)) l(label) group by 1, 2),
m as (select split, label, coalesce(tp / nullif(said, 0), 0) as precision, coalesce(tp / nullif(support, 0), 0) as recall,
    2.0 * tp / (said + support) as f1, support from c),
r as (select split, label::varchar as name, precision, recall, f1, support from m
  union all select split, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) from m group by 1
  union all select split, 'weighted avg', sum(precision * support) / sum(support),
    sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) from m group by 1
  union all select split, 'accuracy', avg((y = pred)::int), avg((y = pred)::int), avg((y = pred)::int), count(*)
    from judged group by 1)
select split, name, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1,
  support::bigint as support from r""")
def e8_classification_report(spark, sf_dir):
    return rounded(evaluate.classification_report(evaluate.confusion_matrix(_judged(spark, sf_dir))))


@query("e9_evaluate_splits", f"""with {SCORED}, {E7_SQL},
judged as (select s.*, (p > threshold)::int as pred from scored s, best),
auc as ({AUC_SQL.format('judged')})
select split, round(avg((y = pred)::int), 6) as accuracy, round(2.0 * count(*) filter (y = 1 and pred = 1)
  / (count(*) filter (y = 1) + count(*) filter (pred = 1)), 6) as f1, round(any_value(auroc), 6) as auroc
from judged join auc using (split) group by split""")
def e9_evaluate_splits(spark, sf_dir):
    return rounded(evaluate.evaluate_splits(scored_rows(spark, sf_dir)))


@query("e10_log_loss", f"""with {SCORED} select split, round(avg(case when y = 1 then -2.5 * ln(p)
  else -ln(1 - p) end), 6) as loss from scored group by split""")
def e10_log_loss(spark, sf_dir):
    return rounded(evaluate.log_loss(scored_rows(spark, sf_dir), pos_weight=2.5))


@query("e10_saturated", f"""with {SCORED}, q as (select split, y, case when p > 0.6 then 0.0
  else p end as p from scored)
select split, avg(case when y = 1 then case when p = 0 then 'infinity'::double else -ln(p) end
  else -ln(1 - p) end) = 'infinity'::double as infinite from q group by split""")
def e10_saturated(spark, sf_dir):
    rows = scored_rows(spark, sf_dir).withColumn("p", F.when(F.col("p") > 0.6, 0.0).otherwise(F.col("p")))
    return evaluate.log_loss(rows).select("split", (F.col("loss") == float("inf")).alias("infinite"))


def scored_vectors(spark, sf_dir):
    """Vectors scored over 64 classes, one per position, by the softmax of all positions."""
    whole = F.transform("embedding", lambda x: x.cast("double") * 8)
    rows = vectors(spark, sf_dir).select("node_id", "y", numbers.softmax(whole).alias("probs"))
    pred = numbers.argmax(F.col("probs"))
    return sampling.split_rowwise(rows).select("node_id", "split", "y", pred.alias("pred"), "probs")


MULTI = """e as (select vec_id, label as y, [exp(8 * x::double) for x in embedding] as v from embeddings),
scored as (select vec_id, y, [x / list_sum(v) for x in v] as probs,
    (list_position(v, list_max(v)) - 1)::int as pred,
    case when vec_id < floor(n * 0.8::double) then 'train'
      when vec_id < floor(n * 0.8::double) + floor(n * 0.1::double) then 'val' else 'test' end as split
  from e, (select count(*) as n from embeddings)),
flat as (select split, c as cls, probs[c + 1] as p, (y = c)::int as y from scored, range(64) r(c))"""
MACRO = """counts as (select split, label, count(*) filter (y = label and pred = label) as tp,
    count(*) filter (pred = label) as said, count(*) filter (y = label) as support
  from scored, range(64) l(label) group by 1, 2),
macro as (select split, avg(2.0 * tp / (said + support)) as f1_macro from counts where said + support > 0 group by 1)"""


@query("e4_f1_multiclass", f"""with {MULTI}, {MACRO} select split, round(avg((y = pred)::int), 6) as f1_micro,
  round(any_value(f1_macro), 6) as f1_macro from scored join macro using (split) group by split""")
def e4_f1_multiclass(spark, sf_dir):
    return rounded(evaluate.f1_multiclass(evaluate.confusion_matrix(scored_vectors(spark, sf_dir))))


@query("e6_auroc_ovr_macro", f"""with {MULTI},
s as (select split, cls, p, count(*) filter (y = 1) as pos, count(*) filter (y <> 1) as neg from flat group by 1, 2, 3),
b as (select *, sum(neg) over (partition by split, cls order by p rows unbounded preceding) - neg as below from s),
a as (select split, cls, sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) as auroc from b group by 1, 2)
select split, round(avg(auroc), 6) as auroc from a group by split""")
def e6_auroc_ovr_macro(spark, sf_dir):
    return rounded(evaluate.auroc_ovr_macro(scored_vectors(spark, sf_dir)))


@query("e10_cross_entropy", f"""with {MULTI} select split,
  round(sum(-ln(probs[y + 1]) * (1 + y / 10.0)) / sum(1 + y / 10.0), 6) as loss from scored group by split""")
def e10_cross_entropy(spark, sf_dir):
    return rounded(evaluate.cross_entropy(scored_vectors(spark, sf_dir), [1 + c / 10.0 for c in range(64)]))


# --- graphs and classifiers -------------------------------------------------


@query("g9_data_features", """
with n as (select c_custkey as node_id, c_acctbal as acctbal, c_nationkey::double as nation,
  c_custkey < floor((select count(*) from customer) * 0.8::double) as fit from customer),
s as (select avg(acctbal) as m, stddev_pop(acctbal) as d, avg(nation) as m2, stddev_pop(nation) as d2 from n where fit)
select node_id, round((acctbal - m) / d, 6) as acctbal, round((nation - m2) / d2, 6) as nation from n, s""")
def g9_data_features(spark, sf_dir):
    nodes = customer_counts(spark, sf_dir).select("node_id", "acctbal", F.col("nation").cast("double"))
    scaled = graph.data_features(sampling.split_rowwise(nodes), ["acctbal", "nation"])
    return rounded(scaled.drop("split"))


@query("x16_similarity_by_type", """
with g as (select coalesce('=' || nullif(c_mktsegment, 'BUILDING'), 'missing') as v, count(*) as m
  from customer group by 1)
select v as a, v as b, 1.0::double as sim, m as m_a, m as m_b from g where m > 1""")
def x16_similarity_by_type(spark, sf_dir):
    return registry.similarity(customer_counts(spark, sf_dir), "categorical", "segment").pairs


@query("f1_preprocessed_categories", """
select p_partkey as node_id, p_type || '|' || replace(p_name, ' ', '|') as product_category from part""")
def f1_preprocessed_categories(spark, sf_dir):
    nodes = src.product(spark, sf_dir).select(
        F.col("product_id").alias("node_id"), F.col("category_tree").alias("product_category"))
    cleaned = registry.preprocess(nodes, "product_category")
    return cleaned.withColumn("product_category", F.array_join("product_category", "|"))


def _snapshot_nodes(spark, sf_dir):
    """Customers labelled by whether they spent more than the mean, with three numbers to learn from:
    the number of orders tells much of it, not all."""
    spent = src.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("node_id")).agg(F.sum("o_totalprice").alias("spent"))
    nodes = customer_counts(spark, sf_dir).join(spent, "node_id", "left").withColumn("spent", F.coalesce("spent", F.lit(0.0)))
    rich = with_scalars(nodes, nodes.agg(F.avg("spent").alias("mean")))
    return rich.select("node_id", (F.col("spent") > F.col("mean")).cast("int").alias("y"), "acctbal", "n_orders", F.col("nation").cast("double"))


#: The same customers, split by rank and scaled on the training rows, in SQL.
SNAPSHOT = f"""{CUSTOMERS}, money as (select n.*, coalesce((select sum(o_totalprice) from orders where o_custkey = n.node_id), 0) as spent from nodes n),
labelled as (select node_id, acctbal, n_orders, nation::double as nation, (spent > (select avg(spent) from money))::int as y,
    case when node_id < floor((select count(*) from money) * 0.8::double) then 'train'
      when node_id < floor((select count(*) from money) * 0.8::double) + floor((select count(*) from money) * 0.1::double) then 'val' else 'test' end as split
  from money),
fitted as (select avg(acctbal) as ma, stddev_pop(acctbal) as da, avg(n_orders) as mn, stddev_pop(n_orders) as dn,
    avg(nation) as mc, stddev_pop(nation) as dc from labelled where split = 'train'),
scaled as (select node_id, split, y, (acctbal - ma) / da as acctbal, (n_orders - mn) / dn as n_orders, (nation - mc) / dc as nation
  from labelled, fitted)"""


def _scaled_snapshot(spark, sf_dir):
    return graph.data_features(sampling.split_rowwise(_snapshot_nodes(spark, sf_dir)), ["acctbal", "n_orders", "nation"])


def _moments(scored, weight, labels: int, columns: list[str]):
    """(label, feature, moment): the weighted mean of p[label] * feature on the train rows."""
    entries = F.array(*[F.struct(F.lit(c).alias("label"), F.lit(name).alias("feature"), (
        F.element_at("probs", c + 1) * value * weight).alias("v")) for c in range(labels)
        for name, value in [("bias", F.lit(1.0)), *[(x, F.col(x)) for x in columns]]])
    rows = scored.filter("split = 'train'").select(F.inline(entries))
    return rows.groupBy("label", "feature").agg(F.avg("v").alias("moment"))


@query("l5_l8_l9_binary_experiment")
def l5_l8_l9_binary_experiment(spark, sf_dir):
    nodes = sampling.split_stratified(_snapshot_nodes(spark, sf_dir), "y")
    linked = graph.Graph.above(sim.sim_exact(customer_counts(spark, sf_dir), "nation"), 0.5)
    return experiment.run_experiment(nodes, linked, ["acctbal", "n_orders"], "GCN", hops=(1,))[1]


# A fit without a penalty is a minimum exactly where, for every label and feature, the weighted mean of
# the fitted probability times the feature equals that of the label itself. The right side needs no
# model, so these oracles are the data's own moments.


@query("l5_optimal_fit", f"""
with {SNAPSHOT}, w as (select *, case when y = 1 then 2.0 else 1.0 end as w from scaled where split = 'train')
select c::integer as label, f as feature, round(avg(case when y = c then w * case f when 'bias' then 1.0
    when 'acctbal' then acctbal when 'n_orders' then n_orders else nation end else 0.0 end), 5) + 0.0 as moment
from w, range(2) r(c), (values ('bias'), ('acctbal'), ('n_orders'), ('nation')) t(f) group by 1, 2""")
def l5_optimal_fit(spark, sf_dir):
    nodes = _scaled_snapshot(spark, sf_dir)
    columns = ["acctbal", "n_orders", "nation"]
    scored = learn.score(learn.train_binary(nodes, columns, pos_weight=2.0, max_iter=300, tol=1e-12), nodes)
    found = _moments(scored, F.when(F.col("y") == 1, 2.0).otherwise(1.0), 2, columns)
    return found.withColumn("moment", F.round("moment", 5) + F.lit(0.0))


#: Newton's steps on (bias, n_orders): the weights of the best fit, in SQL.
NEWTON = f"""{SNAPSHOT}, t as (select n_orders as x, y from scaled where split = 'train'),
newton(step, b, w) as (
  select 0, 0.0::double, 0.0::double
  union all
  select step + 1, b - (hww * gb - hbw * gw) / (hbb * hww - hbw * hbw), w - (hbb * gw - hbw * gb) / (hbb * hww - hbw * hbw)
  from (select any_value(step) as step, any_value(b) as b, any_value(w) as w, sum(p - y) as gb, sum((p - y) * x) as gw,
      sum(p * (1 - p)) as hbb, sum(p * (1 - p) * x) as hbw, sum(p * (1 - p) * x * x) as hww
    from (select step, b, w, x, y, 1 / (1 + exp(-(b + w * x))) as p from newton, t where step < 25) having count(*) > 0))"""


@query("l9_threshold_scores", f"""
with recursive {NEWTON}, best as (select b, w from newton where step = 25)
select node_id, split, y, round(1 / (1 + exp(-(b + w * n_orders))), 4) as p, (1 / (1 + exp(-(b + w * n_orders))) > 0.4)::integer as pred
from scaled, best""")
def l9_threshold_scores(spark, sf_dir):
    """Probabilities and labels of the best fit on the number of orders."""
    nodes = _scaled_snapshot(spark, sf_dir)
    scored = learn.score(learn.train_binary(nodes, ["n_orders"], max_iter=300, tol=1e-13), nodes, threshold=0.4)
    return scored.select("node_id", "split", "y", F.round("p", 4).alias("p"), "pred")


@query("l6_optimal_multiclass", """
with s as (select *, label as y, case when vec_id < floor(n * 0.8::double) then 1 else 0 end as fit
  from embeddings, (select count(*) as n from embeddings)),
w as (select y, unnest([1.0::double, embedding[1]::double, embedding[2]::double, embedding[3]::double]) as v,
    unnest(['bias', 'x1', 'x2', 'x3']) as f, 1 + y / 10.0 as w from s where fit = 1)
select c::integer as label, f as feature, round(avg(case when y = c then v * w else 0.0 end), 5) + 0.0 as moment
from w, range(10) r(c) group by 1, 2""")
def l6_optimal_multiclass(spark, sf_dir):
    nodes = sampling.split_rowwise(vectors(spark, sf_dir)).select("node_id", "split", "y", *[
        F.element_at("embedding", i).cast("double").alias(f"x{i}") for i in (1, 2, 3)])
    columns = ["x1", "x2", "x3"]
    fitted = learn.train_multiclass(nodes, columns, [1 + c / 10.0 for c in range(10)], max_iter=500, tol=1e-13)
    found = _moments(learn.score(fitted, nodes, None), 1 + F.col("y") / F.lit(10.0), 10, columns)
    return found.withColumn("moment", F.round("moment", 5) + F.lit(0.0))


@query("l7_mlp_scores", f"""
with {SNAPSHOT} select c::integer as label, 'bias' as feature, round(avg((y = c)::int), 2) as moment
from scaled, range(2) r(c) where split = 'train' group by 1""")
def l7_mlp_scores(spark, sf_dir):
    """At a minimum the output layer's biases balance: mean probabilities are the label shares."""
    nodes = _scaled_snapshot(spark, sf_dir)
    columns = ["acctbal", "n_orders", "nation"]
    fitted = learn.train_mlp(nodes, columns, [4], max_iter=400)
    found = _moments(learn.score(fitted, nodes), F.lit(1.0), 2, []).filter("feature = 'bias'")
    return found.withColumn("moment", F.round("moment", 2))


@query("l8_select_best", f"""
with {SNAPSHOT}, cand(no, name) as (values (1, 'acctbal'), (2, 'n_orders'), (3, 'n_orders_again'), (4, 'nation')),
s as (select no, name, y, case name when 'acctbal' then acctbal when 'nation' then nation else n_orders end as p from scaled, cand where split = 'val'),
g as (select no, name, p, count(*) filter (y = 1) as pos, count(*) filter (y <> 1) as neg from s group by 1, 2, 3),
b as (select *, sum(neg) over (partition by no order by p rows unbounded preceding) - neg as below from g),
a as (select no, name, sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) as auroc from b group by 1, 2)
select name as candidate, round(auroc, 6) as auroc from a order by a.auroc desc, no limit 1""")
def l8_select_best(spark, sf_dir):
    """Of four scores the one with the best validation AUROC, the first of equals."""
    nodes = _scaled_snapshot(spark, sf_dir)
    scores = [("acctbal", "acctbal"), ("n_orders", "n_orders"), ("n_orders_again", "n_orders"), ("nation", "nation")]
    name, scored, value = learn.select_best(((n, nodes.withColumn("p", F.col(c))) for n, c in scores), "auroc")
    return rounded(scored.agg(F.lit(name).alias("candidate"), F.lit(value).alias("auroc")))


@query("e9_evaluate_multiclass", f"""with {MULTI}, {MACRO},
s as (select split, cls, p, count(*) filter (y = 1) as pos, count(*) filter (y <> 1) as neg from flat group by 1, 2, 3),
b as (select *, sum(neg) over (partition by split, cls order by p rows unbounded preceding) - neg as below from s),
c as (select split, cls, sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) as auroc from b group by 1, 2),
a as (select split, avg(auroc) as auroc from c group by 1)
select split, round(avg((y = pred)::int), 6) as accuracy, round(avg((y = pred)::int), 6) as f1_micro,
  round(any_value(f1_macro), 6) as f1_macro, round(any_value(auroc), 6) as auroc
from scored join macro using (split) join a using (split) group by split""")
def e9_evaluate_multiclass(spark, sf_dir):
    return rounded(evaluate.evaluate_multiclass(scored_vectors(spark, sf_dir)))


@query("e10_from_raw", f"""with {SCORED}, q as (select split, y, (0.5 - p) * 4000 as raw from scored)
select split, round(avg(case when y = 1 then 2.5 * (greatest(-raw, 0) + ln(1 + exp(-abs(raw)))) else greatest(raw, 0) + ln(1 + exp(-abs(raw))) end), 6) as loss
from q group by split""")
def e10_from_raw(spark, sf_dir):
    """Scores whose probabilities round to 0 and 1 have finite losses."""
    rows = scored_rows(spark, sf_dir).withColumn("raw", (0.5 - F.col("p")) * 4000)
    return rounded(evaluate.log_loss(rows.withColumn("p", numbers.sigmoid(F.col("raw"))), pos_weight=2.5))


@query("e10_cross_entropy_from_raws", """
with e as (select label as y, list_transform(embedding, lambda x: x::double * 5000) as v, case when vec_id < floor(n * 0.8::double) then 'train'
    when vec_id < floor(n * 0.8::double) + floor(n * 0.1::double) then 'val' else 'test' end as split
  from embeddings, (select count(*) as n from embeddings))
select split, round(avg(list_max(v) + ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v))))) - v[y + 1]), 6) as loss from e group by split""")
def e10_cross_entropy_from_raws(spark, sf_dir):
    raws = F.transform("embedding", lambda x: x.cast("double") * 5000)
    rows = sampling.split_rowwise(vectors(spark, sf_dir).select("node_id", "y", raws.alias("raws")))
    return rounded(evaluate.cross_entropy(rows))


@query("l6_multiclass_experiment")
def l6_multiclass_experiment(spark, sf_dir):
    nodes = sampling.split_stratified(vectors(spark, sf_dir), "y")
    columns = [f"x{i}" for i in range(64)]
    nodes = nodes.select("node_id", "y", "split", *[
        F.element_at("embedding", i + 1).cast("double").alias(c) for i, c in enumerate(columns)])
    return experiment.run_experiment(
        nodes, _vector_graph(spark, sf_dir), columns, "GraphSAGE", hops=(1,), regs=(0.01,), num_classes=10)[1]
