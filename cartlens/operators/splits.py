"""Time-based train/test splits. Each returns (train, test) as lazy frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlens.config import DAY_MS
from cartlens.functions.columns import millis
from cartlens.functions.ranking import positions_in_time, value_at_position


def _check_share(test_size: float) -> None:
    if not 0.0 < test_size < 1.0:
        raise ValueError("test_size must be in (0, 1)")


def _two_sides(df: DataFrame, in_train: Column) -> tuple[DataFrame, DataFrame]:
    return df.filter(in_train), df.filter(~in_train)


def mark_split_per_user(
    df: DataFrame, test_size: float, ties: Sequence[str] = ("item_id",), heavy_rows: int = 1_000_000, at_most: DataFrame | None = None
) -> DataFrame:
    """Adds ``is_train``: true for the first max(1, floor(n * (1 - test_size))) rows of a user by time.

    Rows without a time count towards n and are dropped. Writing this frame once serves both sides of the split.
    ``at_most`` (user_id, _n) are upper bounds of the users' rows, see ``positions_in_time``.
    """
    _check_share(test_size)
    columns = df.columns
    placed = positions_in_time(df, "user_id", "timestamp", ties, heavy_rows, at_most)
    cut = F.greatest(F.lit(1).cast("double"), F.floor(F.col("_n") * F.lit(1.0 - test_size)).cast("double"))
    return placed.withColumn("is_train", F.col("_r") <= cut).select(*columns, "is_train")


def temporal_split_per_user(
    df: DataFrame, test_size: float, ties: Sequence[str] = ("item_id",), at_most: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Last share of every user's rows to test. Works on interactions, or on events with a fuller tie-break.

    ``at_most`` as in ``mark_split_per_user``."""
    marked = mark_split_per_user(df, test_size, ties, at_most=at_most)
    train, test = _two_sides(marked, F.col("is_train"))
    return train.drop("is_train"), test.drop("is_train")


def global_cut_timestamp(interactions: DataFrame, test_size: float) -> DataFrame:
    """One row ``value``: the time at position int(n * (1 - test_size)), kept inside [1, n - 1]."""
    _check_share(test_size)
    wanted = F.floor(F.col("n") * F.lit(1.0 - test_size))
    position = F.when(wanted <= 0, F.lit(1)).when(wanted >= F.col("n"), F.col("n") - 1).otherwise(wanted)
    return value_at_position(interactions, "timestamp", position)


def temporal_split_global(interactions: DataFrame, test_size: float) -> tuple[DataFrame, DataFrame]:
    cut = global_cut_timestamp(interactions, test_size).scalar()
    timed = interactions.filter(F.col("timestamp").isNotNull())
    return _two_sides(timed, F.col("timestamp") < cut)


def global_time_split(
    interactions: DataFrame, events: DataFrame, split_date: str | None = None, test_size: float = 0.15
) -> tuple[DataFrame, DataFrame]:
    """Cut at an ISO date, or at the last event minus int(days spanned * test_size) days."""
    if split_date is not None:
        cut = F.unix_millis(F.lit(split_date).cast("timestamp"))
    else:
        times = events.select(millis(events, "timestamp").alias("_t"))
        days = F.floor((F.max("_t") - F.min("_t")) / F.lit(DAY_MS))
        cut = times.agg(F.max("_t") - F.floor(days * F.lit(float(test_size))) * F.lit(DAY_MS)).scalar()
    return _two_sides(interactions, millis(interactions, "timestamp") < cut)


def validation_cutoff_split(events: DataFrame, validation_size: float) -> tuple[DataFrame, DataFrame]:
    """Cut at the last event minus int(seconds spanned * validation_size) seconds."""
    times = events.select(millis(events, "timestamp").alias("_t"))
    seconds = (F.max("_t") - F.min("_t")) / F.lit(1000.0)
    cut = times.agg(F.max("_t") - F.floor(seconds * F.lit(float(validation_size))) * F.lit(1000)).scalar()
    return _two_sides(events, millis(events, "timestamp") < cut)
