"""Rounding for result comparison across engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def r6(column: Column | str) -> Column:
    """Six digits, free of negative zero."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, 6) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    """Every double column through :func:`r6`."""
    return df.select(*[
        r6(f.name).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ])
