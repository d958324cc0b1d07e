"""Training rows with a recent review of a yearly best seller, sampled several times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgraph.distributed import materialize
from tabgraph.operators.joins import window_exists
from tabgraph.operators.rows import top_k_per_year
from tabgraph.operators.sampling import sample_repeated, sample_stratified


def top_product_pool(
    train: DataFrame, facts: DataFrame, top_k: int, time_window: str | None = None
) -> DataFrame:
    """Rows whose customer reviewed one of the year's top products by then.

    All years in one plan. A year without facts has no top products and yields
    no rows.
    """
    top = top_k_per_year(facts, "product_id", "review_time", top_k).select("year", "product_id")
    # A fact counts for every year in which its product is a best seller; rows of a year lie
    # before its end, so later facts can match none of them.
    bought = facts.select("customer_id", "product_id", "review_time").join(top, "product_id").filter(
        F.year("review_time") <= F.col("year"))
    rows = train.withColumn("year", F.year("timestamp"))
    kept = window_exists(
        rows, bought.select("customer_id", "year", "review_time"), ["customer_id", "year"],
        "timestamp", "review_time", time_window,
    )
    return kept.select(*train.columns)


def draw_samples(
    train: DataFrame, facts: DataFrame, top_k: int | None = 1000, time_window: str | None = None,
    sample_size: int = 5000, n_files: int = 1, churn_ratio: float | None = None,
    churn_column: str = "churn", seed: int = 123,
) -> DataFrame:
    """Optional best-seller filter, then ``n_files`` plain or class-balanced draws."""
    pool = train
    if top_k is not None:
        # Sized and drawn from separately, so computed once.
        pool = materialize(top_product_pool(train, facts, top_k, time_window))
    keys = ["customer_id", "timestamp"]
    if churn_ratio is None:
        return sample_repeated(pool, sample_size, n_files, keys, seed)
    return sample_stratified(pool, sample_size, churn_ratio, keys, churn_column, n_files, seed)
