"""Category-aware re-ranking of recommendation lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlens.functions.ranking import top_per_group

# Category scores, and (history rows below, weight of rank, weight of category).
SAME_CATEGORY = 1.0
NEAR_CATEGORY = 0.5
OTHER_CATEGORY = 0.2
TOP_CATEGORIES = 3
HISTORY_STEPS = ((5, 0.3, 0.7), (20, 0.5, 0.5))


def top_user_categories(history: DataFrame, n: int = TOP_CATEGORIES) -> DataFrame:
    """(user_id, category_id, n, pos): each user's most frequent categories, smaller id first among equals."""
    counts = (
        history.filter(F.col("category_id").isNotNull())
        .groupBy("user_id", "category_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return top_per_group(counts, ["user_id"], [F.desc("n"), F.asc("category_id")], n, "pos")


def tree_neighbours(tree: DataFrame) -> DataFrame:
    """(category_id, neighbour_id): parent and child pairs in both directions."""
    edges = tree.filter(F.col("parent_id").isNotNull())
    down = edges.select("category_id", F.col("parent_id").alias("neighbour_id"))
    up = edges.select(F.col("parent_id").alias("category_id"), F.col("category_id").alias("neighbour_id"))
    return down.unionByName(up).distinct()


def adaptive_weights(history: DataFrame, users: DataFrame, alpha: float, beta: float) -> DataFrame:
    """(user_id, history_len, w_rank, w_category): short histories lean on categories."""
    lengths = history.groupBy("user_id").agg(F.count(F.lit(1)).alias("history_len"))
    people = users.select("user_id").distinct()
    return _weigh(people.join(lengths, "user_id", "left").fillna({"history_len": 0}), alpha, beta)


def _weigh(df: DataFrame, alpha: float, beta: float, adaptive: bool = True) -> DataFrame:
    rank_weight, category_weight = F.lit(float(alpha)), F.lit(float(beta))
    if adaptive:
        for below, by_rank, by_category in reversed(HISTORY_STEPS):
            short = F.col("history_len") < below
            rank_weight = F.when(short, F.lit(by_rank)).otherwise(rank_weight)
            category_weight = F.when(short, F.lit(by_category)).otherwise(category_weight)
    return df.withColumn("w_rank", rank_weight).withColumn("w_category", category_weight)


def normalised_popularity(stats: DataFrame) -> DataFrame:
    """(category_id, popularity): events over the largest category's events."""
    largest = stats.agg(F.max("n_events").cast("double").alias("m"))
    top = largest.select(F.when(F.col("m") == 0, F.lit(1.0)).otherwise(F.col("m"))).scalar()
    return stats.select("category_id", (F.col("n_events") / top).alias("popularity"))


def _user_profiles(history: DataFrame, parents: DataFrame | None) -> DataFrame:
    """Per user: history length, top categories, and the parents of those categories (three sets at most)."""
    lengths = history.groupBy("user_id").agg(F.count(F.lit(1)).alias("history_len"))
    favourites = top_user_categories(history).select("user_id", "category_id")
    if parents is None:
        liked = favourites.groupBy("user_id").agg(
            F.collect_set("category_id").alias("_liked"), F.array().cast("array<bigint>").alias("_above")
        )
    else:
        liked = (
            favourites.join(parents, "category_id", "left")
            .groupBy("user_id")
            .agg(
                F.collect_set("category_id").alias("_liked"),
                F.flatten(F.collect_list(F.coalesce("_parents", F.array().cast("array<bigint>")))).alias("_above"),
            )
        )
    return lengths.join(liked, "user_id", "left")


def score_candidates(
    recs: DataFrame,
    history: DataFrame,
    metadata: DataFrame,
    stats: DataFrame,
    tree: DataFrame | None = None,
    alpha: float = 0.7,
    beta: float = 0.3,
    adaptive: bool = True,
) -> DataFrame:
    """``recs`` with ``category_id`` and ``final_score``.

    Being a tree neighbour of a liked category means: a parent of the item's category is liked, or the category is a
    parent of a liked one. Both need only upward links, so a category with very many children adds nothing.
    """
    parents = None
    catalogue = metadata.select("item_id", "category_id").join(normalised_popularity(stats), "category_id", "left")
    if tree is not None:
        parents = (
            tree.filter(F.col("parent_id").isNotNull())
            .groupBy("category_id")
            .agg(F.collect_set("parent_id").alias("_parents"))
        )
        catalogue = catalogue.join(parents, "category_id", "left")
    else:
        catalogue = catalogue.withColumn("_parents", F.lit(None).cast("array<bigint>"))
    joined = (
        recs.join(catalogue, "item_id", "left")
        .join(_user_profiles(history, parents), "user_id", "left")
        .fillna({"history_len": 0})
    )
    category = F.col("category_id")

    def yes(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False))

    near = yes(F.arrays_overlap("_parents", "_liked")) | yes(F.array_contains("_above", category))
    category_score = (
        F.when(category.isNull(), F.lit(0.0))
        .when(yes(F.array_contains("_liked", category)), F.lit(SAME_CATEGORY))
        .when(near, F.lit(NEAR_CATEGORY))
        .otherwise(F.lit(OTHER_CATEGORY) * F.coalesce("popularity", F.lit(0.0)))
    )
    rank_score = F.when(F.col("rank") > 0, F.lit(1.0) / F.col("rank")).otherwise(F.lit(0.0))
    weighed = _weigh(joined, alpha, beta, adaptive)
    return weighed.withColumn(
        "final_score", F.col("w_rank") * rank_score + F.col("w_category") * category_score
    ).select(*recs.columns, "category_id", "final_score")


def category_rerank(
    recs: DataFrame,
    history: DataFrame,
    metadata: DataFrame,
    stats: DataFrame,
    tree: DataFrame | None = None,
    top_k: int | Column = 5,
    alpha: float = 0.7,
    beta: float = 0.3,
    adaptive: bool = True,
    list_keys: Sequence[str] = ("user_id",),
) -> DataFrame:
    """The best top_k of each list by final score, renumbered; the earlier rank wins among equal scores.

    ``list_keys`` name one list; serving keeps several lists per user apart with more keys.
    """
    columns = recs.columns
    scored = score_candidates(recs, history, metadata, stats, tree, alpha, beta, adaptive)
    order = Window.partitionBy(*list_keys).orderBy(F.desc("final_score"), F.asc("rank"), F.asc("item_id"))
    # One list per group: bounded by the length of a recommendation list.
    placed = scored.withColumn("_new", F.row_number().over(order)).filter(F.col("_new") <= top_k)
    return placed.withColumn("rank", F.col("_new")).select(*columns)
