"""Shop data derived from the star-schema tables: events, property history, category tree and request log.

The tables have no shop log, so orders stand in for user events, parts for catalogue properties, and the ``events``
table for the request and business event log. Every view reads whole tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.config import PRODUCTION, InteractionConfig
from cartlens.operators import features, popular, serving, splits
from cartlens.operators.validation import clean_category_tree, clean_events, clean_item_properties, tag_events
from cartlens.session import configure, scratch, stage

# Fixed values of the mapping, the same as in the SQL twins of these views.
SHIFT_MS = 456_624_000_000  # moves 1995-2001 ship dates to 2009-2016
DAY_S = 86_400
FIRST_PROPERTY_MS = 1_262_304_000_000
SECOND_PROPERTY_MS = 1_420_070_400_000
CATEGORY_BASE = 100


class ShopViews:
    """Lazy views over one folder of parquet tables."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = configure(spark)
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def raw_events(self) -> DataFrame:
        """Shop events with nulls, unknown types, early times, zero ids and repeated rows left in."""
        order, line, quantity = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_quantity")
        event = (
            F.when(quantity <= 40, "view").when(quantity <= 46, "addtocart").when(quantity <= 49, "transaction").otherwise("refund")
        )
        copies = F.when(order % 97 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        rows = self.table("lineitem").join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        return rows.select(
            (
                F.unix_millis(F.col("l_shipdate").cast("timestamp")) + F.lit(SHIFT_MS) + (order * 7 + line) % DAY_S * 1000
            ).alias("timestamp"),
            F.when(order % 101 != 0, F.col("o_custkey")).alias("user_id"),
            F.col("l_partkey").alias("item_id"),
            event.alias("event"),
            F.when(event == "transaction", order.cast("string")).alias("transaction_id"),
            F.explode(copies).alias("_copy"),
        ).drop("_copy")

    @cached_property
    def tagged_events(self) -> DataFrame:
        return tag_events(self.raw_events)

    @cached_property
    def events(self) -> DataFrame:
        return clean_events(self.raw_events)

    @cached_property
    def stored_events(self) -> DataFrame:
        """Clean events written once, for chains that read them several times."""
        return stage(self.events, "clean-events")

    @cached_property
    def raw_properties(self) -> DataFrame:
        key = F.col("p_partkey")
        brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
        first, second = F.lit(FIRST_PROPERTY_MS) + key * 1000, F.lit(SECOND_PROPERTY_MS) + key * 1000

        def row(time, name, value):
            return F.struct(time.alias("timestamp"), F.lit(name).alias("property"), value.cast("string").alias("value"))

        always = [
            row(first, "categoryid", F.lit(CATEGORY_BASE) + key % 25),
            row(second, "available", F.col("p_size") % 2),
        ]
        moved = row(second, "categoryid", F.lit(CATEGORY_BASE) + brand)
        rows = F.when(key % 5 != 0, F.array(*always, moved)).otherwise(F.array(*always))
        return self.table("part").select(key.alias("item_id"), F.inline(rows)).select(
            "timestamp", "item_id", "property", "value"
        )

    @cached_property
    def properties(self) -> DataFrame:
        return clean_item_properties(self.raw_properties)

    @cached_property
    def raw_tree(self) -> DataFrame:
        """A leaf per brand under six middle categories and two roots, with absent parents and a cycle."""
        brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("bigint")
        brands = self.table("part").select(brand.alias("b")).distinct()
        slot = F.col("b") % 6
        leaves = brands.select(
            (F.lit(CATEGORY_BASE) + F.col("b")).alias("category_id"),
            F.when(slot == 0, F.lit(999)).otherwise(F.lit(10) + slot).cast("bigint").alias("parent_id"),
        )
        upper = self.spark.sql(
            """SELECT * FROM VALUES (10L, 1L), (11L, 2L), (12L, 1L), (13L, 2L), (14L, 1L), (15L, 2L),
               (1L, NULL), (2L, NULL), (50L, 51L), (51L, 50L) AS t(category_id, parent_id)"""
        )
        return leaves.unionByName(upper)

    @cached_property
    def tree(self) -> DataFrame:
        """Written once: the walk down the tree reads it level by level."""
        return stage(clean_category_tree(self.raw_tree), "tree")

    @cached_property
    def categories(self) -> DataFrame:
        """Written once: one row per item, which most chains join several times."""
        return stage(features.latest_categories(self.properties), "categories")

    @cached_property
    def mixed_categories(self) -> DataFrame:
        """Categories with a third of the items moved up to a middle category, and some left without one."""
        category, item = F.col("category_id"), F.col("item_id")
        slot = (category - CATEGORY_BASE) % 6
        return self.categories.select(
            "item_id",
            F.when((item % 3 == 0) & (slot != 0), F.lit(10) + slot).when(item % 17 != 0, category).alias("category_id"),
        )

    @cached_property
    def category_stats(self) -> DataFrame:
        """Written once: one row per category."""
        return stage(features.category_stats(self.stored_events, self.categories, pairs=self.pairs), "category-stats")

    @cached_property
    def pairs(self) -> DataFrame:
        """Written once: one row per user and item, for interactions and for counts by category."""
        return stage(features.user_item_pairs(self.stored_events, PRODUCTION.interactions.weights), "pairs")

    def interactions(self, config: InteractionConfig = PRODUCTION.interactions) -> DataFrame:
        if config.weights != PRODUCTION.interactions.weights:
            return features.build_interactions(self.stored_events, config)
        return features.build_interactions(self.stored_events, config, self.pairs, self.user_sizes.select("user_id", "_n"))

    @cached_property
    def user_sizes(self) -> DataFrame:
        """Written once: pairs and events of every user, for the filter and for both splits."""
        counts = F.count(F.lit(1)).alias("_n"), F.sum("_n").alias("_events")
        return stage(self.pairs.groupBy("user_id").agg(*counts), "user-sizes")

    @cached_property
    def item_totals(self) -> DataFrame:
        """Written once: rows and summed rating of every training item, for catalogue, novelty and popularity."""
        sums = F.count(F.lit(1)).alias("n"), F.sum("rating").alias("rating")
        return stage(self.train.groupBy("item_id").agg(*sums), "item-totals")

    @cached_property
    def split(self) -> tuple[DataFrame, DataFrame]:
        """Both sides of the per-user split, read from one written frame: lists, metrics and stats use them repeatedly."""
        interactions = self.interactions()
        at_most = self.user_sizes.select("user_id", "_n")
        with scratch(self.spark) as keep:
            marked = keep(splits.mark_split_per_user(interactions, PRODUCTION.test_size, at_most=at_most), "split")
        train, test = marked.filter("is_train"), marked.filter("NOT is_train")
        return train.drop("is_train"), test.drop("is_train")

    @cached_property
    def train(self) -> DataFrame:
        return self.split[0]

    @cached_property
    def test(self) -> DataFrame:
        return self.split[1]

    @cached_property
    def test_events(self) -> DataFrame:
        return stage(self.event_split[1], "test-events")

    @cached_property
    def event_split(self) -> tuple[DataFrame, DataFrame]:
        ties = ("item_id", "event", "transaction_id")
        at_most = self.user_sizes.select("user_id", F.col("_events").alias("_n"))
        return splits.temporal_split_per_user(self.stored_events, PRODUCTION.test_size, ties, at_most)

    @cached_property
    def targets(self) -> DataFrame:
        return features.target_pairs(self.test, self.test_events)

    @cached_property
    def history(self) -> DataFrame:
        return features.user_history(self.train, self.categories)

    @cached_property
    def popular(self) -> DataFrame:
        """Written once: a hundred rows that lists, fallbacks and scalars read again and again."""
        return stage(popular.top_popular_items(self.item_totals, PRODUCTION.evaluation.popular_k), "popular")

    @cached_property
    def recs(self) -> DataFrame:
        """Deterministic lists: the 20 most popular items the user has not seen."""
        return popular.popular_unseen(self.test, self.popular, self.train, 20)

    @cached_property
    def log(self) -> DataFrame:
        return request_log(self.table("events"))

    @cached_property
    def log_stream(self) -> DataFrame:
        """The same log read as a stream of files."""
        source = self.spark.read.parquet(f"{self.folder}/events.parquet").schema
        files = self.spark.readStream.schema(source).option("pathGlobFilter", "events.parquet")
        return request_log(files.parquet(self.folder))

    @cached_property
    def requests(self) -> DataFrame:
        """One request per view of the log; every seventh has a bad size, odd ones ask for their own side."""
        key = F.col("event_id")
        return self.table("events").filter(F.col("event_type") == "view").select(
            key.alias("request_id"),
            F.when(key % 11 == 0, -F.col("user_id") - 1).otherwise(F.col("user_id")).alias("user_id"),
            F.when(key % 7 == 0, F.lit(0)).when(key % 5 == 0, F.lit(20)).otherwise(F.lit(10)).alias("top_k"),
            F.when(key % 3 == 0, F.lit(True)).when(key % 3 == 1, F.lit(False)).alias("use_rerank"),
            (key % 13 == 0).alias("use_baseline"),
            F.when(key % 4 == 0, "auto").when(key % 4 == 1, "als").when(key % 4 == 2, "baseline").alias("ab_test_group"),
        )


    @cached_property
    def routed(self) -> DataFrame:
        return stage(serving.route_requests(self.requests, self.train.select("user_id")), "routed")

    @cached_property
    def serving_lists(self) -> DataFrame:
        """Personal lists from deterministic candidates: unseen popular items, scored by popularity."""
        people = self.routed.filter(F.col("model_type").isin("als", "rerank"))
        scores = F.broadcast(self.popular.select("item_id", "score"))  # k rows
        candidates = popular.popular_unseen(people, self.popular, self.train, serving.batch_depth(self.routed)).join(
            scores, "item_id"
        )
        history = self.train.join(self.categories, "item_id", "left").select("user_id", "item_id", "category_id")
        return serving.personal_lists(
            self.routed,
            candidates.withColumnRenamed("rank", "cand_rank"),
            features.purchases(self.stored_events),
            F.lit(self.item_totals.agg(F.count("item_id")).scalar()),
            history,
            self.categories,
            self.category_stats,
            self.tree,
        )

    @cached_property
    def served(self) -> DataFrame:
        return serving.answer_requests(self.routed, self.serving_lists, self.popular)


def request_log(events: DataFrame) -> DataFrame:
    """The monitoring log from an ``events`` table, batch or streaming."""
    kind, user = F.col("event_type"), F.col("user_id")
    event = (
        F.when(kind == "view", "impression")
        .when(kind == "signup", "addtocart")
        .when(kind == "purchase", "transaction")
        .otherwise(kind)
    )
    model = (
        F.when(user % 4 == 0, "als").when(user % 4 == 1, "rerank").when(user % 4 == 2, "baseline").otherwise("fallback")
    )
    served = kind == "view"
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("item_id"),
        event.alias("event"),
        F.when(kind == "purchase", F.col("value")).otherwise(F.lit(0.0)).alias("revenue"),
        model.alias("model_type"),
        F.when(kind == "error", F.lit(500)).otherwise(F.lit(200)).alias("status"),
        F.when(kind.isin("view", "error"), "/recommendations").otherwise("/events").alias("endpoint"),
        (F.col("value") / 100.0).alias("latency_s"),
        (served & (user % 4 >= 2)).alias("cold"),
        F.when(served, F.get_json_object("props", "$.k").cast("bigint")).alias("n_recs"),
    )
