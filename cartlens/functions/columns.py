"""Small column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.config import EventWeights


def distinct_total(df: DataFrame, column: str) -> Column:
    """How many different values a column has, as a scalar; nulls do not count.

    Each such count is its own grouped aggregate. Two of them in one aggregate would copy every row per count.
    """
    values = df.filter(F.col(column).isNotNull()).select(column).distinct()
    return F.lit(values.agg(F.count(F.lit(1)).alias("n")).scalar())


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "input") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks required columns: {missing}")
    return df


def event_weight(event: str = "event", weights: EventWeights = EventWeights()) -> Column:
    """Weight of an event; anything unknown counts as a view."""
    return (
        F.when(F.col(event) == "addtocart", F.lit(float(weights.addtocart)))
        .when(F.col(event) == "transaction", F.lit(float(weights.transaction)))
        .otherwise(F.lit(float(weights.view)))
    )


def millis(df: DataFrame, column: str) -> Column:
    """Epoch milliseconds of a long, timestamp or zone-less timestamp column."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_millis(F.col(column).cast("timestamp"))
    return F.col(column).cast("long")


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, 0 when the denominator is not positive."""
    return F.when(denominator > 0, numerator.cast("double") / denominator).otherwise(F.lit(0.0))


def pct_change(new: Column, old: Column) -> Column:
    return (new / old - 1.0) * 100.0


def md5_bucket(key: Column, buckets: int) -> Column:
    """Repeatable bucket of a text key, from the first 8 hex digits of its md5."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % F.lit(buckets)
