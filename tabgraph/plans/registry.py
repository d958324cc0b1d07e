"""Similarity by type and column name (X16), and its two extension points (F1, F2)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabgraph.functions.text import clean_author_list, flatten_and_filter
from tabgraph.operators.date_similarity import sim_date
from tabgraph.operators.rows import is_list, require_columns
from tabgraph.operators.rules import association_rules, frequent_itemsets, rule_map
from tabgraph.operators.similarity import (
    Similarity, sim_count_checked, sim_distribution, sim_exact, sim_grouped, sim_numeric, sim_overlap,
)
from tabgraph.operators.text_similarity import sim_text

# Default support and lift of the item rules.
MIN_SUPPORT, MIN_LIFT = 0.03, 1.2


def categorical(nodes: DataFrame, column: str, min_sim: float = 0.0, related: DataFrame | None = None,
                use_rules: bool = True, min_support: float = MIN_SUPPORT, min_lift: float = MIN_LIFT,
                **_) -> Similarity:
    """List cells: overlap, widened by mined rules unless switched off. Scalars: equality or groups."""
    if is_list(nodes, column):
        mined = None
        if use_rules:
            mined = rule_map(association_rules(frequent_itemsets(nodes, column, min_support), min_lift))
        return sim_overlap(nodes, column, mined, min_sim)
    return sim_exact(nodes, column) if related is None else sim_grouped(nodes, column, related)


def numeric(nodes: DataFrame, column: str, min_sim: float, **_) -> Similarity:
    build = sim_distribution if is_list(nodes, column) else sim_numeric
    return build(nodes, column, min_sim)


def review_count(nodes: DataFrame, column: str, min_sim: float, features: DataFrame, **_) -> Similarity:
    return sim_count_checked(nodes, features, min_sim, column)


def text(nodes: DataFrame, column: str, min_sim: float, **_) -> Similarity:
    return sim_text(nodes, column, min_sim)


def date(nodes: DataFrame, column: str, min_sim: float, reference: str = "timestamp",
         id_column: str | None = None, **_) -> Similarity:
    return sim_date(nodes, column, reference, min_sim, id_column)


SIMILARITIES: dict[str, Callable[..., Similarity]] = {
    "categorical": categorical,
    "numeric": numeric,
    "review_count": review_count,
    "text": text,
    "date": date,
}


def _category_lists(cells: Column) -> Column:
    return flatten_and_filter(cells)


PREPROCESSORS: dict[str, Callable[[Column], Column]] = {
    "product_brand": clean_author_list,
    "product_category": _category_lists,
}


def register_similarity(kind: str, build: Callable[..., Similarity]) -> None:
    """a further similarity type."""
    SIMILARITIES[kind] = build


def register_preprocessor(column: str, clean: Callable[[Column], Column]) -> None:
    """cleaning applied to a column of this name unless disabled."""
    PREPROCESSORS[column] = clean


def preprocess(nodes: DataFrame, column: str) -> DataFrame:
    """the registered cleaning of a column, if any."""
    clean = PREPROCESSORS.get(column)
    return nodes if clean is None else nodes.withColumn(column, clean(F.col(column)))


def similarity(nodes: DataFrame, kind: str, column: str, *, use_preprocessor: bool = True, **options) -> Similarity:
    """Similarity of one column of the node table, by registered type."""
    if kind not in SIMILARITIES:
        raise ValueError(f"unknown similarity type {kind!r}; known: {sorted(SIMILARITIES)}")
    if kind != "review_count":
        require_columns(nodes, ["node_id", column])
    if use_preprocessor and kind != "review_count":
        nodes = preprocess(nodes, column)
    return SIMILARITIES[kind](nodes, column, **options)
