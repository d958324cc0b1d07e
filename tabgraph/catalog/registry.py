"""Named queries and, where SQL can say the same, their oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query callable under ``name``, with its oracle."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def r6(expr: str, alias: str) -> str:
    """Oracle text of a float rounded to six digits, free of negative zero."""
    return f"round({expr}, 6) + 0.0 as {alias}"


# Oracle views of the three adapters.
FACT = """fact as (
  select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey,
      l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
      l_shipdate) - 1 as review_id,
    o_custkey as customer_id, l_partkey as product_id, o_orderdate as review_time,
    l_quantity as rating, l_returnflag = 'R' as verified
  from lineitem join orders on l_orderkey = o_orderkey)"""
PRODUCT = """product as (
  select p_partkey as product_id, p_name as title, p_brand as brand,
    p_retailprice as price, p_type as category,
    [['Books', p_type], string_split(p_name, ' ')] as category_tree
  from part)"""
TRAIN = """snap as (
  select unnest(generate_series(timestamp '1996-01-01', timestamp '2001-01-01',
    interval 6 month)) as ts),
active as (
  select distinct o_custkey, ts from orders join snap
    on o_orderdate >= ts and o_orderdate < ts + interval 3 month),
train as (
  select row_number() over (order by s.ts, c_custkey) - 1 as node_id,
    s.ts as "timestamp", c_custkey as customer_id,
    case when a.ts is null then 1 else 0 end as churn
  from customer cross join snap s
  left join active a on a.o_custkey = c_custkey and a.ts = s.ts)"""
