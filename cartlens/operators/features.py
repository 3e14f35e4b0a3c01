"""Interactions, catalogue metadata and popularity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.config import TARGET_EVENTS, EventWeights, InteractionConfig
from cartlens.functions.columns import distinct_total, event_weight, require_columns
from cartlens.session import stage

MAX_TREE_ROUNDS = 20


def weighted_events(events: DataFrame, weights: EventWeights = EventWeights()) -> DataFrame:
    return events.withColumn("event_weight", event_weight("event", weights))


def user_item_pairs(events: DataFrame, weights: EventWeights = EventWeights()) -> DataFrame:
    """One row per (user, item): summed weight, last time and ``_n``, the number of events."""
    return events.groupBy("user_id", "item_id").agg(
        F.sum(event_weight("event", weights)).alias("rating"), F.max("timestamp").alias("timestamp"), F.count(F.lit(1)).alias("_n")
    )


def build_interactions(
    events: DataFrame,
    config: InteractionConfig = InteractionConfig(),
    pairs: DataFrame | None = None,
    user_sizes: DataFrame | None = None,
) -> DataFrame:
    """Pairs whose user and item both have enough pairs, counted once on the unfiltered pairs.

    The pairs are written once: left lazy, each of their three readers would aggregate the events again, since they
    need different columns. The counts then read one key column each and return as semi joins, so a user or item that
    owns a large share of the pairs never has them gathered in one window. The rows come out by user, as splits want
    them. ``pairs`` are written ``user_item_pairs`` of the events by the weights of the config, if there are any, and
    ``user_sizes`` (user_id, _n) their written counts by user.
    """
    require_columns(events, ["user_id", "item_id", "event", "timestamp"], "events")
    if pairs is None:
        pairs = stage(user_item_pairs(events, config.weights).drop("_n"), "pairs")
    kept = pairs
    for key, least in (("item_id", config.min_item_interactions), ("user_id", config.min_user_interactions)):
        if least > 1:
            known = user_sizes if key == "user_id" else None
            sizes = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("_n")) if known is None else known
            frequent = sizes.filter(F.col("_n") >= least).select(key)
            # the keys of a task are hashed, which spares sorting the pairs
            kept = kept.join(frequent.hint("shuffle_hash"), key, "left_semi")
    return kept.select("user_id", "item_id", "rating", "timestamp")


def latest_categories(properties: DataFrame, strict: bool = True) -> DataFrame:
    """Last known category per item; the larger category wins among equal times."""
    text = F.col("value")
    category = text.cast("long") if strict else text.try_cast("long")
    return (
        properties.filter(F.col("property") == "categoryid")
        .select("item_id", category.alias("category_id"), "timestamp")
        .groupBy("item_id")
        .agg(F.max_by("category_id", F.struct("timestamp", "category_id")).alias("category_id"))
    )


def item_availability(properties: DataFrame) -> DataFrame:
    """Last availability text per item; a null last value stays null."""
    return (
        properties.filter(F.col("property") == "available")
        .groupBy("item_id")
        .agg(F.max(F.struct("timestamp", "value")).alias("_last"))
        .select("item_id", F.col("_last.value").alias("available_value"))
    )


def category_levels(tree: DataFrame, orphan_as_root: bool = False) -> DataFrame:
    """(category_id, level): roots are 1, a child is its parent's level plus one, for at most 20 rounds.

    Orphans and cycles keep a null level. With ``orphan_as_root`` an absent parent counts as a root at level 1, so an
    orphan is at level 2.
    """
    spark = tree.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    edges = tree.select("category_id", "parent_id")
    roots = edges.filter(F.col("parent_id").isNull()).select("category_id", F.lit(1).alias("level"))
    if orphan_as_root:
        known = edges.select(F.col("category_id").alias("parent_id")).distinct()
        orphans = edges.filter(F.col("parent_id").isNotNull()).join(known, "parent_id", "left_anti")
        roots = roots.unionByName(orphans.select("category_id", F.lit(2).alias("level")))
    reached = spark.sql(
        f"""
        WITH RECURSIVE walk(category_id, level) AS (
          SELECT category_id, level FROM {{roots}}
          UNION ALL
          SELECT e.category_id, w.level + 1
          FROM walk w JOIN {{edges}} e ON e.parent_id = w.category_id
          WHERE w.level <= {MAX_TREE_ROUNDS}
        )
        SELECT category_id, min(level) AS level FROM walk GROUP BY category_id
        """,
        roots=roots,
        edges=edges,
    )
    return edges.select("category_id").join(reached, "category_id", "left")


def tree_with_levels(tree: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    found = (category_levels(tree) if levels is None else levels).distinct()
    return tree.join(found, "category_id", "left").select("category_id", "parent_id", "level")


def category_stats(
    events: DataFrame, categories: DataFrame, approximate: bool = False, pairs: DataFrame | None = None
) -> DataFrame:
    """Events, users and items per category.

    Events shrink to (user, item) counts before meeting the categories, so repeated views by one user or of one item
    are combined before any shuffle by category. Users and items are counted in grouped steps of their own.
    ``pairs`` are written ``user_item_pairs`` of the events, if there are any.
    """
    if pairs is not None:
        return category_stats_of_pairs(pairs, categories, pairs.select("item_id").distinct(), approximate)
    pairs = events.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("_n"))
    return category_stats_of_pairs(pairs, categories, events.select("item_id").distinct(), approximate)


def category_stats_of_pairs(pairs: DataFrame, categories: DataFrame, seen: DataFrame, approximate: bool = False) -> DataFrame:
    """The same from (user_id, item_id, _n) and the items seen."""
    known = categories.filter(F.col("category_id").isNotNull()).select("item_id", "category_id")
    categorised = pairs.join(known, "item_id")
    if approximate:
        users = categorised.groupBy("category_id").agg(
            F.sum("_n").alias("n_events"), F.approx_count_distinct("user_id").alias("n_users")
        )
    else:
        per_user = categorised.groupBy("category_id", "user_id").agg(F.sum("_n").alias("_n"))
        users = per_user.groupBy("category_id").agg(F.sum("_n").alias("n_events"), F.count("user_id").alias("n_users"))
    items = known.distinct().join(seen, "item_id", "left_semi").groupBy("category_id").agg(F.count("item_id").alias("n_items"))
    return users.join(items, "category_id").select("category_id", "n_events", "n_users", "n_items")


def item_popularity(
    events: DataFrame, weights: EventWeights = EventWeights(), pairs: DataFrame | None = None
) -> DataFrame:
    """Events, users and weighted score per item, summed over (user, item) pairs.

    ``pairs`` are written ``user_item_pairs`` of the events by these weights, if there are any.
    """
    if pairs is not None:
        return popularity_of_pairs(pairs.withColumnRenamed("rating", "_w"))
    pairs = events.groupBy("item_id", "user_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(event_weight("event", weights)).alias("_w")
    )
    return popularity_of_pairs(pairs)


def popularity_of_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("item_id").agg(
        F.sum("_n").alias("n_events"), F.count("user_id").alias("n_users"), F.sum("_w").alias("weighted_score")
    )


def item_metadata(
    categories: DataFrame, levels: DataFrame, availability: DataFrame, popularity: DataFrame
) -> DataFrame:
    """Category, level, availability and popularity per categorised item; missing counts become 0."""
    return (
        categories.join(levels.distinct(), "category_id", "left")
        .join(availability, "item_id", "left")
        .join(popularity, "item_id", "left")
        .fillna({"n_events": 0, "n_users": 0, "weighted_score": 0.0})
        .select("item_id", "category_id", "level", "available_value", "n_events", "n_users", "weighted_score")
    )


def purchases(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event") == "transaction").select("user_id", "item_id").distinct()


def purchase_counts(bought: DataFrame) -> DataFrame:
    """Distinct bought items per user. Serving anti-joins the pairs themselves rather than building a set per user."""
    pairs = bought.select("user_id", "item_id").distinct()
    return pairs.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_purchased"))


def target_pairs(test: DataFrame, test_events: DataFrame) -> DataFrame:
    """Test interactions that the user also added to the cart or bought in the test events."""
    wanted = test_events.filter(F.col("event").isin(*TARGET_EVENTS)).select("user_id", "item_id").distinct()
    return test.join(wanted, ["user_id", "item_id"], "left_semi")


def user_history(train: DataFrame, categories: DataFrame) -> DataFrame:
    known = categories.select("item_id", "category_id").filter(F.col("category_id").isNotNull())
    return train.join(known, "item_id").select("user_id", "item_id", "category_id")


def events_of_pairs(events: DataFrame, train: DataFrame) -> DataFrame:
    """All events of training pairs, whatever their time."""
    # the training pairs of a task are hashed, which spares sorting them
    return events.join(train.select("user_id", "item_id").hint("shuffle_hash"), ["user_id", "item_id"], "left_semi")


def split_stats(train: DataFrame, test: DataFrame) -> DataFrame:
    """One row of sizes for the training report."""

    def sizes(side: DataFrame, name: str) -> DataFrame:
        return side.agg(F.count(F.lit(1)).alias(f"{name}_interactions")).select(
            distinct_total(side, "user_id").alias(f"{name}_users"),
            distinct_total(side, "item_id").alias(f"{name}_items"),
            f"{name}_interactions",
        )

    trained = train.select("user_id").distinct()
    warm = test.select("user_id").distinct().join(trained, "user_id", "left_semi").agg(F.count(F.lit(1)).alias("n"))
    tests = sizes(test, "test")
    return sizes(train, "train").select(
        "*",
        *[F.lit(tests.select(c).scalar()).alias(c) for c in tests.columns],
        F.lit(warm.scalar()).alias("warm_users_in_test"),
        F.col("train_users").alias("n_users_in_model"),
        F.col("train_items").alias("n_items_in_model"),
    )


def artifact_counts(categories: DataFrame, availability: DataFrame) -> DataFrame:
    """One row: items with a category, distinct categories, items with an availability record."""
    return categories.sparkSession.range(1).select(
        distinct_total(categories, "item_id").alias("items_with_category"),
        distinct_total(categories, "category_id").alias("n_categories"),
        distinct_total(availability, "item_id").alias("items_with_availability"),
    )
