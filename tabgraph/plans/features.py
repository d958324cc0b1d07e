"""The customer feature frame over a look-back window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabgraph.functions.timewin import total_days
from tabgraph.operators.joins import attach, enrich, window_join

# The feature names, in the order downstream models expect.
FEATURES = [
    "num_reviews",
    "num_unique_products",
    "avg_rating",
    "std_rating",
    "min_rating",
    "max_rating",
    "num_verified_purchases",
    "num_unique_categories",
    "num_unique_brands",
    "avg_product_price",
    "std_product_price",
    "min_product_price",
    "max_product_price",
    "days_since_last_review",
    "days_since_first_review",
    "review_frequency",
]
TRAIN_KEY = ["customer_id", "timestamp", "churn"]


def n_unique(column: str) -> Column:
    """A2: distinct values, null counting as one value."""
    return F.count_distinct(F.col(column)) + F.max(F.col(column).isNull().cast("long"))


def fill_missing(df: DataFrame) -> DataFrame:
    """Null and NaN to 0 in every numeric column."""
    return df.na.fill(0)


def windowed_reviews(train: DataFrame, facts: DataFrame, products: DataFrame, window: str) -> DataFrame:
    """J2 + J3: reviews inside each training row's window, with product columns."""
    reviews = enrich(facts, products, "product_id", ["price", "category", "brand"])
    return window_join(train, reviews, "customer_id", "timestamp", "review_time", window)


def customer_features(
    train: DataFrame, facts: DataFrame, products: DataFrame, window: str = "-6mo",
    dedupe: bool = False,
) -> DataFrame:
    """Sixteen features per training row, zeros where the window is empty.

    Groups are (customer, timestamp, label): repeated training rows count their
    reviews repeatedly, and each gets the same totals back. ``dedupe`` counts
    them once.

    One plan at every size: distinct values are shuffled by value and combine map-side, so no
    task holds a set of them, and the largest customer is spread over many tasks.
    """
    base = train.select(*TRAIN_KEY)
    rows = base.distinct() if dedupe else base
    timed = _grouped_features(windowed_reviews(rows, facts, products, window))
    framed = attach(train, timed, TRAIN_KEY).select(*train.columns, *FEATURES)
    return fill_missing(framed)


def _grouped_features(reviews: DataFrame) -> DataFrame:
    """The sixteen features of every training key with reviews."""
    grouped = reviews.groupBy(*TRAIN_KEY).agg(
        F.count(F.lit(1)).alias("num_reviews"),
        n_unique("product_id").alias("num_unique_products"),
        F.avg("rating").alias("avg_rating"),
        F.stddev_samp("rating").alias("std_rating"),
        F.min("rating").alias("min_rating"),
        F.max("rating").alias("max_rating"),
        F.count_if("verified").alias("num_verified_purchases"),
        n_unique("category").alias("num_unique_categories"),
        n_unique("brand").alias("num_unique_brands"),
        F.avg("price").alias("avg_product_price"),
        F.stddev_samp("price").alias("std_product_price"),
        F.min("price").alias("min_product_price"),
        F.max("price").alias("max_product_price"),
        F.max("review_time").alias("_last"),
        F.min("review_time").alias("_first"),
    )
    ts = F.col("timestamp")
    since_first = total_days(ts, F.col("_first"))
    return grouped.withColumns({
        "days_since_last_review": total_days(ts, F.col("_last")),
        "days_since_first_review": since_first,
        "review_frequency": F.col("num_reviews") / (since_first / F.lit(30.0) + F.lit(1e-6)),
    }).select(*TRAIN_KEY, *FEATURES)
