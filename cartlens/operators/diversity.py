"""Category cap on recommendation lists with popular items of unseen categories as replacements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def apply_diversity_constraint(
    recs: DataFrame,
    metadata: DataFrame,
    max_items_per_category: int = 2,
    popular: DataFrame | None = None,
    list_size: int | None = None,
) -> DataFrame:
    """Keep the best items per category and all uncategorised ones, then refill from categories not shown yet.

    ``popular`` holds (category_id, pos, item_id). Replacements come category by category in id order, a category
    may give several, and the j-th gets rank kept + j; the merged list is renumbered by rank, kept items first.
    ``list_size`` is the length no list exceeds; left out, one extra pass over ``recs`` finds it.
    """
    if popular is not None and list_size is None:
        longest = recs.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"))
        list_size = int(longest.first()["n"] or 0)
    categories = metadata.select("item_id", "category_id")
    in_category = Window.partitionBy("user_id", "category_id").orderBy("rank", "item_id")
    marked = (
        recs.select("user_id", "item_id", "rank")
        .join(categories, "item_id", "left")
        .withColumn("_keep", F.col("category_id").isNull() | (F.row_number().over(in_category) <= max_items_per_category))
    )
    # A list is bounded by its length n, so the per-user arrays below hold n entries at most.
    lists = marked.groupBy("user_id").agg(
        F.collect_list(F.when(F.col("_keep"), F.struct("rank", "item_id"))).alias("_kept"),
        F.collect_set(F.when(F.col("_keep"), F.col("category_id"))).alias("_shown"),
        F.count(F.lit(1)).alias("_size"),
    )
    if list_size is not None:
        too_long = F.raise_error(F.lit(f"a list is longer than list_size={list_size}")).cast("bigint")
        lists = lists.withColumn("_size", F.when(F.col("_size") > list_size, too_long).otherwise(F.col("_size")))
    kept_entry = F.transform("_kept", lambda e: _entry(e["rank"], 0, e["item_id"]))
    if popular is None:
        merged: Column = kept_entry
    else:
        needed = F.col("_size") - F.size("_kept")
        lists = lists.withColumn("_pool", _replacement_pool(popular, 2 * list_size))
        unseen = F.filter("_pool", lambda c: ~F.array_contains(F.col("_shown"), c["category_id"]))
        present = F.transform("_kept", lambda e: e["item_id"])
        # array_except keeps the order and drops repeats
        offered = F.array_except(F.flatten(F.transform(unseen, lambda c: c["items"])), present)
        fills = F.when(needed > 0, F.slice(offered, F.lit(1), needed.cast("int"))).otherwise(
            F.array().cast("array<bigint>")
        )
        fill_entry = F.transform(fills, lambda item, j: _entry(F.size("_kept") + j + 1, 1, item))
        merged = F.concat(kept_entry, fill_entry)
    ordered = lists.select("user_id", F.posexplode(F.array_sort(merged)).alias("_pos", "_e"))
    return ordered.select("user_id", F.col("_e.item_id").alias("item_id"), (F.col("_pos") + 1).alias("rank"))


def _entry(rank: Column, is_fill: int, item: Column) -> Column:
    return F.struct(rank.cast("int").alias("rank"), F.lit(is_fill).alias("is_fill"), item.alias("item_id"))


def _replacement_pool(popular: DataFrame, n_categories: int) -> Column:
    """One array of (category_id, items), long enough for every user.

    A user skips at most the shown categories, and at most one category per kept item can be used up by items already
    present; every other category gives at least one item. So the first shown + kept + needed categories always
    suffice, which is at most two list lengths: the pool's size follows the lists, not the catalogue.
    """
    firsts = popular.select("category_id").distinct().orderBy("category_id").limit(n_categories)
    by_category = (
        popular.join(F.broadcast(firsts), "category_id", "left_semi")
        .groupBy("category_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "item_id"))).alias("_ranked"))
        .select("category_id", F.transform("_ranked", lambda e: e["item_id"]).alias("items"))
    )
    listed = by_category.agg(F.array_sort(F.collect_list(F.struct("category_id", "items"))).alias("_pool"))
    empty = F.array().cast("array<struct<category_id: bigint, items: array<bigint>>>")
    return F.coalesce(listed.scalar(), empty)
