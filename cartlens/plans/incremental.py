"""Catalogue tables that grow with new files instead of being built from all of them.

State, each table under the folder of the load that wrote it last:

- clean events and (user, item) counts per span of PERIOD_DAYS days: a load rewrites the spans its rows fall into,
  together with what they held, so rows that come again in a later file are the duplicates they are in one file;
- the last category and availability of every item with their times.

A manifest names the current folder of every span and table and the loads it contains. It is written last, under a new
number: a load that broke off leaves files nobody reads, and a load that is repeated changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.config import DAY_MS, EventWeights
from cartlens.functions.columns import event_weight
from cartlens.operators import features, validation
from cartlens.session import exists, stage
from cartlens.sources import artifacts

PERIOD_DAYS = 30
_EMPTY: dict[str, Any] = {"number": 0, "loads": [], "spans": {}, "categories": None, "availability": None}
_SPREAD = 4  # files of a span
_CATEGORIES = "item_id bigint, category_id bigint, timestamp bigint"
_AVAILABILITY = "item_id bigint, value string, timestamp bigint"


def manifest(spark: SparkSession, state: str) -> dict[str, Any]:
    """The newest manifest: one small JSON row, an entry per span of the calendar."""
    if not exists(spark, f"{state}/manifest"):
        return dict(_EMPTY)
    rows = spark.read.schema("value string, number int").option("wholetext", True).text(f"{state}/manifest")
    newest = rows.orderBy(F.desc("number")).first()
    return artifacts.json.loads(newest["value"]) if newest else dict(_EMPTY)


def _span() -> Column:
    return F.floor(F.col("timestamp") / F.lit(PERIOD_DAYS * DAY_MS))


def _write_spans(rows: DataFrame, folder: str) -> DataFrame:
    """Written with few files per span, which none of the tasks gets whole."""
    dealt = rows.repartition("span", F.pmod(F.xxhash64("user_id", "item_id"), F.lit(_SPREAD)))
    dealt.write.partitionBy("span").parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def _merged_state(spark: SparkSession, path: str | None, schema: str, new: DataFrame, last) -> DataFrame:
    rows = spark.read.schema(schema).parquet(path).unionByName(new) if path else new
    return rows.groupBy("item_id").agg(last)


def load(
    spark: SparkSession,
    state: str,
    name: str,
    events: DataFrame | None = None,
    properties: DataFrame | None = None,
    weights: EventWeights = EventWeights(),
) -> bool:
    """Take in raw events and properties under a name; False if that name has been loaded before."""
    now = manifest(spark, state)
    if name in now["loads"]:
        return False
    folder = f"{state}/load-{uuid.uuid4().hex}"
    spans, made = dict(now["spans"]), {}
    if events is not None:
        new = stage(validation.clean_events(events), "new-events")
        touched = [r["span"] for r in new.select(_span().alias("span")).distinct().collect()]  # spans of the calendar
        held = [f"{spans[str(k)]}/events/span={k}" for k in touched if str(k) in spans]
        rows = new.unionByName(spark.read.schema(new.schema).parquet(*held)).distinct() if held else new
        stored = _write_spans(rows.withColumn("span", _span()), f"{folder}/events")
        pairs = stored.groupBy("span", "user_id", "item_id").agg(
            F.count(F.lit(1)).alias("_n"), F.sum(event_weight("event", weights)).alias("_w")
        )
        _write_spans(pairs, f"{folder}/pairs")
        spans |= {str(k): folder for k in touched}
    if properties is not None:
        clean = validation.clean_item_properties(properties)
        known = clean.filter(F.col("property") == "categoryid").select("item_id", F.col("value").cast("long").alias("category_id"), "timestamp")
        order = F.struct("timestamp", "category_id")
        states = {
            "categories": _merged_state(spark, now["categories"], _CATEGORIES, known, F.max(order).alias("_s")),
            "availability": _merged_state(
                spark,
                now["availability"],
                _AVAILABILITY,
                clean.filter(F.col("property") == "available").select("item_id", "value", "timestamp"),
                F.max(F.struct("timestamp", "value")).alias("_s"),
            ),
        }
        for table, rows in states.items():
            made[table] = f"{folder}/{table}"
            rows.select("item_id", "_s.*").write.parquet(made[table])
    artifacts.save_json(spark, now | made | {"number": now["number"] + 1, "loads": [*now["loads"], name], "spans": spans}, f"{state}/manifest/number={now['number'] + 1}")
    return True


def tables(spark: SparkSession, state: str, tree: DataFrame) -> Mapping[str, DataFrame]:
    """The five catalogue tables of all loads so far, from span counts and item states; no event is read again."""
    now = manifest(spark, state)
    pair = "user_id bigint, item_id bigint, _n bigint, _w double"
    paths = [f"{folder}/pairs/span={span}" for span, folder in now["spans"].items()]
    counts = spark.read.schema(pair).parquet(*paths) if paths else spark.createDataFrame([], pair)
    pairs = counts.groupBy("user_id", "item_id").agg(F.sum("_n").alias("_n"), F.sum("_w").alias("_w"))

    def read(name: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(now[name]) if now[name] else spark.createDataFrame([], schema)

    categories = read("categories", _CATEGORIES).select("item_id", "category_id")
    availability = read("availability", _AVAILABILITY).select("item_id", F.col("value").alias("available_value"))
    popularity = features.popularity_of_pairs(pairs)
    levels = features.category_levels(tree)
    return {
        "item_availability": availability,
        "item_popularity": popularity,
        "category_tree": features.tree_with_levels(tree, levels),
        "category_stats": features.category_stats_of_pairs(pairs, categories, pairs.select("item_id").distinct()),
        "item_metadata": features.item_metadata(categories, levels, availability, popularity),
    }
