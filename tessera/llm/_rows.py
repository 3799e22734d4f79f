"""Rows by their place, where no column names them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import written


def stored(df: DataFrame) -> DataFrame:
    """``df`` so that it is dealt alike each time it is read: stored, if a shuffle makes it."""
    return written(df, "rows") if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def placed(df: DataFrame, place: str) -> DataFrame:
    """Add the column ``place`` (long, unique): the same for a row each time the result is read."""
    return stored(df).withColumn(place, F.monotonically_increasing_id())
