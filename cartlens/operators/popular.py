"""Popularity lists and everything recommended from them.

A popularity list has at most k rows. It reaches the users as one array from a scalar subquery, so giving every user
a list is an explode of k elements and needs no join with the users at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlens.config import TARGET_EVENTS
from cartlens.functions.ranking import top_per_group

_TASKS_PER_CORE = 4


def _ranked_top(scores: DataFrame, k: int) -> DataFrame:
    top = scores.orderBy(F.desc("score"), F.asc("item_id")).limit(k)
    # k rows at most
    place = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), F.asc("item_id"))
    return top.withColumn("pop_rank", F.row_number().over(place)).select("item_id", "score", "pop_rank")


def top_popular_items(interactions: DataFrame, k: int) -> DataFrame:
    """(item_id, score, pop_rank): k items with the largest summed rating."""
    return _ranked_top(interactions.groupBy("item_id").agg(F.sum("rating").alias("score")), k)


def top_popular_items_by_cart(
    events: DataFrame, k: int, weight_addtocart: float = 10.0, weight_transaction: float = 8.0
) -> DataFrame:
    """Same, from cart and purchase events only."""
    weight = F.when(F.col("event") == "addtocart", F.lit(float(weight_addtocart))).otherwise(
        F.lit(float(weight_transaction))
    )
    wanted = events.filter(F.col("event").isin(*TARGET_EVENTS))
    return _ranked_top(wanted.groupBy("item_id").agg(F.sum(weight).alias("score")), k)


def popular_by_category(train: DataFrame, categories: DataFrame, k_per_category: int = 10) -> DataFrame:
    """(category_id, pos, item_id): k items with the largest summed rating inside each category."""
    totals = train.groupBy("item_id").agg(F.sum("rating").alias("_total"))
    known = categories.select("item_id", "category_id").filter(F.col("category_id").isNotNull())
    ranked = top_per_group(
        totals.join(known, "item_id"), ["category_id"], [F.desc("_total"), F.asc("item_id")], k_per_category, "pos"
    )
    return ranked.select("category_id", "pos", "item_id")


def popular_array(popular: DataFrame, *extra: str) -> Column:
    """The list as one array of (pop_rank, item_id, ...) in rank order."""
    entry = F.struct("pop_rank", "item_id", *extra)
    listed = popular.agg(F.array_sort(F.collect_list(entry)).alias("_list")).scalar()
    # an expression reads the array even where the subquery result would be null
    return F.coalesce(listed, F.array().cast(_array_type(popular, *extra)))


def _array_type(popular: DataFrame, *extra: str) -> str:
    fields = ", ".join(f"{c}: {popular.schema[c].dataType.simpleString()}" for c in ("pop_rank", "item_id", *extra))
    return f"array<struct<{fields}>>"


def _explode_ranked(users: DataFrame, items: Column) -> DataFrame:
    """A row per user and item. The users are few bytes before and many after, so they are dealt anew to enough tasks.

    By a key, Spark may leave out the exchange and merge the small partitions again.
    """
    spark = users.sparkSession
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), _TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    return users.repartition(parts).select("user_id", F.posexplode(items).alias("_pos", "_item")).select(
        "user_id", F.col("_item.item_id").alias("item_id"), (F.col("_pos") + 1).alias("rank")
    )


def popular_for_users(users: DataFrame, popular: DataFrame, n: int) -> DataFrame:
    """The first n popular items for every user."""
    head = F.slice(popular_array(popular), 1, n)
    return _explode_ranked(users.select("user_id").distinct(), head)


def popular_by_user_categories(
    users: DataFrame, popular: DataFrame, categories: DataFrame, recent_events: DataFrame, n: int
) -> DataFrame:
    """First the popular head's items in categories of the user's recent events, then the rest of the list.

    Only categories of the n head items matter, so each user carries at most n categories.
    """
    known = categories.select("item_id", "category_id").filter(F.col("category_id").isNotNull())
    listed = popular.select("item_id", "pop_rank").join(known, "item_id", "left")
    head_categories = listed.filter((F.col("pop_rank") <= n) & F.col("category_id").isNotNull()).select("category_id")
    people = users.select("user_id").distinct()
    wanted_items = known.join(F.broadcast(head_categories.distinct()), "category_id", "left_semi")  # n rows at most
    seen = (
        recent_events.select("user_id", "item_id")
        .distinct()
        .join(wanted_items, "item_id")
        .select("user_id", "category_id")
        .distinct()
        .groupBy("user_id")
        .agg(F.collect_set("category_id").alias("_cats"))
    )
    people = people.join(seen, "user_id", "left").withColumn("_list", popular_array(listed, "category_id"))

    def matches(entry: Column) -> Column:
        return F.coalesce(
            (entry["pop_rank"] <= n) & F.array_contains(F.col("_cats"), entry["category_id"]), F.lit(False)
        )

    chosen = F.concat(F.filter("_list", matches), F.filter("_list", lambda entry: ~matches(entry)))
    return _explode_ranked(people, F.slice(chosen, 1, n))


def popular_unseen(users: DataFrame, popular: DataFrame, train: DataFrame, n: int) -> DataFrame:
    """The first n popular items the user has not interacted with in training."""
    seen = (
        train.select("user_id", "item_id")
        .join(F.broadcast(popular.select("item_id")), "item_id")  # k rows at most
        .groupBy("user_id")
        .agg(F.collect_set("item_id").alias("_seen"))
    )
    fresh = F.filter(
        "_list", lambda entry: ~F.coalesce(F.array_contains(F.col("_seen"), entry["item_id"]), F.lit(False))
    )
    people = users.select("user_id").distinct().join(seen, "user_id", "left")
    people = people.withColumn("_list", popular_array(popular))
    return _explode_ranked(people, F.slice(fresh, 1, n))
