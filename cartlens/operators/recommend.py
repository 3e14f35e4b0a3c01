"""Lists for a set of test users: the model for known users, popularity for the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.operators.als import FactorModel, top_unseen
from cartlens.operators.matrix import UserItemMatrix
from cartlens.operators.popular import popular_by_user_categories, popular_for_users

MIN_LIST = 20  # Recall@20 needs twenty items
MIN_TRAINER_LIST = 10  # the training command's own report


def warm_cold_users(test: DataFrame, known_users: DataFrame) -> tuple[DataFrame, DataFrame]:
    people = test.select("user_id").distinct()
    known = known_users.select("user_id")
    return people.join(known, "user_id", "left_semi"), people.join(known, "user_id", "left_anti")


def als_recommendations(
    model: FactorModel, matrix: UserItemMatrix, test: DataFrame, eval_k: int, least: int = MIN_LIST
) -> DataFrame:
    warm, _ = warm_cold_users(test, matrix.users)
    return top_unseen(model, matrix, warm, max(eval_k, least)).select("user_id", "item_id", "rank")


def cold_recommendations(
    cold: DataFrame,
    popular: DataFrame,
    n: int,
    categories: DataFrame | None = None,
    recent_events: DataFrame | None = None,
) -> DataFrame:
    if categories is None or recent_events is None:
        return popular_for_users(cold, popular, n)
    return popular_by_user_categories(cold, popular, categories, recent_events, n)


def generate_recommendations(
    model: FactorModel,
    matrix: UserItemMatrix,
    test: DataFrame,
    popular: DataFrame,
    eval_k: int,
    categories: DataFrame | None = None,
    recent_events: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(recommendations, one row of warm and cold user counts)."""
    n = max(eval_k, MIN_LIST)
    warm, cold = warm_cold_users(test, matrix.users)
    personal = top_unseen(model, matrix, warm, n).select("user_id", "item_id", "rank")
    fallback = cold_recommendations(cold, popular, n, categories, recent_events)
    counts = warm.agg(F.count(F.lit(1)).alias("warm_users")).select(
        "warm_users", F.lit(cold.agg(F.count(F.lit(1))).scalar()).alias("cold_users")
    )
    return personal.unionByName(fallback), counts
