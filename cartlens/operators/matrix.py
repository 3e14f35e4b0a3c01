"""User-item matrix in coordinate form with dense indexes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.functions.columns import distinct_total
from cartlens.functions.ranking import dense_index


@dataclass(frozen=True)
class UserItemMatrix:
    coordinates: DataFrame  # user_idx, item_idx, rating
    users: DataFrame  # user_id, user_idx
    items: DataFrame  # item_id, item_idx


def build_user_item_matrix(interactions: DataFrame) -> UserItemMatrix:
    users = dense_index(interactions, "user_id", "user_idx")
    items = dense_index(interactions, "item_id", "item_idx")
    coordinates = (
        interactions.groupBy("user_id", "item_id")
        .agg(F.sum("rating").alias("rating"))
        .join(users, "user_id")
        .join(items, "item_id")
        .select("user_idx", "item_idx", "rating")
    )
    return UserItemMatrix(coordinates, users, items)


def sparsity(events: DataFrame) -> DataFrame:
    """One row: users, items, events and the empty share of the user-item grid in percent."""
    return events.agg(F.count(F.lit(1)).alias("n_events")).select(
        distinct_total(events, "user_id").alias("n_users"), distinct_total(events, "item_id").alias("n_items"), "n_events"
    ).withColumn(
        "sparsity_pct",
        F.when(
            F.col("n_users") * F.col("n_items") > 0,
            (1.0 - F.col("n_events") / (F.col("n_users").cast("double") * F.col("n_items"))) * 100.0,
        ),
    )
