"""Readers and writers, exercised on files written from the shop views."""

import uuid

from pyspark.sql import functions as F

from cartlens.catalog.registry import query
from cartlens.operators import abtest, features
from cartlens.session import shared_folder
from cartlens.sources import artifacts, readers


def new_folder(s, name: str) -> str:
    return f"{shared_folder(s.spark).rstrip('/')}/cartlens/{name}-{uuid.uuid4().hex}"


def write_raw_events(s, folder: str) -> None:
    s.raw_events.select(
        "timestamp",
        F.col("user_id").alias("visitorid"),
        F.col("item_id").alias("itemid"),
        "event",
        F.col("transaction_id").alias("transactionid"),
    ).write.csv(f"{folder}/{readers.EVENTS_FILE}", header=True)


def write_raw_properties(s, folder: str) -> None:
    rows = s.raw_properties.select("timestamp", F.col("item_id").alias("itemid"), "property", "value")
    early = F.col("timestamp") < 1_400_000_000_000
    rows.filter(early).write.csv(f"{folder}/{readers.PROPERTY_FILES[0]}", header=True)
    rows.filter(~early).write.csv(f"{folder}/{readers.PROPERTY_FILES[1]}", header=True)


def write_raw_tree(s, folder: str) -> None:
    s.raw_tree.select(F.col("category_id").alias("categoryid"), F.col("parent_id").alias("parentid")).write.csv(
        f"{folder}/{readers.TREE_FILE}", header=True
    )


@query("load_events_csv", "SELECT timestamp AS timestamp_ms, user_id, item_id, event, transaction_id FROM rec_events")
def _(s):
    folder = new_folder(s, "raw")
    write_raw_events(s, folder)
    loaded = readers.load_events(s.spark, folder)
    return loaded.select(F.unix_millis("timestamp").alias("timestamp_ms"), "user_id", "item_id", "event", "transaction_id")


@query("load_item_properties_csv", "SELECT timestamp, item_id, property, value FROM rec_properties")
def _(s):
    folder = new_folder(s, "raw")
    write_raw_properties(s, folder)
    return readers.load_item_properties(s.spark, folder)


@query("load_category_tree_csv", "SELECT category_id, parent_id FROM rec_tree")
def _(s):
    folder = new_folder(s, "raw")
    write_raw_tree(s, folder)
    return readers.load_category_tree(s.spark, folder)


_AB = """
SELECT model_type, event, count(*) AS n, round(sum(revenue), 6) AS revenue FROM rec_log GROUP BY 1, 2"""


def _ab_totals(events):
    return events.groupBy("model_type", "event").agg(F.count(F.lit(1)).alias("n"), F.sum("revenue").alias("revenue"))


@query("load_ab_events_parquet", _AB)
def _(s):
    path = f"{new_folder(s, 'ab')}/events.parquet"
    s.log.select("user_id", "item_id", "event", "model_type", "revenue").write.parquet(path)
    return _ab_totals(readers.load_ab_events(s.spark, path))


@query("load_ab_events_csv", _AB)
def _(s):
    path = f"{new_folder(s, 'ab')}/events.csv"
    log = s.log.select("user_id", "item_id", F.col("event").alias("event_type"), "model_type", "revenue")
    log.write.csv(path, header=True)
    return _ab_totals(abtest.adapt_service_log(readers.load_ab_events(s.spark, path)))


@query(
    "required_input_sizes",
    """
SELECT * FROM (VALUES ('category_tree.csv', true), ('events.csv', true), ('item_properties_part1.csv', true),
  ('item_properties_part2.csv', true)) v(file, has_bytes)""",
)
def _(s):
    folder = new_folder(s, "raw")
    write_raw_events(s, folder)
    write_raw_properties(s, folder)
    write_raw_tree(s, folder)
    return readers.check_data_folder(s.spark, folder).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), (F.col("bytes") > 0).alias("has_bytes")
    )


@query(
    "artifact_tables_roundtrip",
    """
SELECT m.item_id, m.category_id, l.level, s.n_events AS category_events
FROM item_categories m LEFT JOIN tree_levels l ON l.category_id = m.category_id
LEFT JOIN cat_stats s ON s.category_id = m.category_id""",
)
def _(s):
    folder = new_folder(s, "artifacts")
    tables = {
        "item_metadata": s.categories,
        "category_stats": s.category_stats,
        "category_tree": features.tree_with_levels(s.tree),
    }
    artifacts.save_artifact_tables(tables, folder)
    artifacts.clear_artifact_cache()
    stats = artifacts.get_category_stats(s.spark, folder).select("category_id", F.col("n_events").alias("category_events"))
    levels = artifacts.get_category_tree(s.spark, folder).select("category_id", "level")
    metadata = artifacts.get_item_metadata(s.spark, folder)
    return metadata.join(levels, "category_id", "left").join(stats, "category_id", "left").select(
        "item_id", "category_id", "level", "category_events"
    )
