"""Artifact tables, model folders and JSON reports."""

from __future__ import annotations

import json
import logging
from collections import OrderedDict
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.functions.columns import require_columns
from cartlens.operators.als import FactorModel
from cartlens.operators.matrix import UserItemMatrix

logger = logging.getLogger(__name__)

# Artifact names with their required columns, and how many stay cached.
ARTIFACT_COLUMNS = {
    "item_metadata": ("item_id", "category_id"),
    "category_stats": ("category_id", "n_events"),
    "category_tree": ("category_id", "parent_id"),
    "item_availability": ("item_id", "available_value"),
    "item_popularity": ("item_id", "n_events"),
}
CACHE_SIZE = 5
METRICS_SCHEMA = "metric string, value double"

_Files = tuple[int, str]
_cache: OrderedDict[tuple[str, str], tuple[_Files, DataFrame]] = OrderedDict()


def _table(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}.parquet"


def load_artifact_cached(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table kept in the executors' cache; the least recently used of six leaves.

    An entry belongs to one application and to the files it was read from: a rewritten table is read anew.
    """
    files = _files(spark, path)
    key = (spark.sparkContext.applicationId, path)
    if key in _cache and _cache[key][0] != files:
        _cache.pop(key)[1].unpersist()
    if key not in _cache:
        _cache[key] = (files, spark.read.parquet(path).cache())
    _cache.move_to_end(key)
    while len(_cache) > CACHE_SIZE:
        (application, _), (_, oldest) = _cache.popitem(last=False)
        if application == key[0]:  # another application's cache ended with it
            oldest.unpersist()
    return _cache[key][1]


def _files(spark: SparkSession, path: str) -> _Files:
    """Number of a table's files, and a digest of their names, sizes and times of change. Files are listed, not read."""
    listed = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    names = listed.select(F.to_json(F.struct("*")).alias("f"))
    row = names.agg(F.count("f").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("f")), " ")).alias("d")).first()
    return row["n"], row["d"]


def clear_artifact_cache(spark: SparkSession | None = None) -> None:
    """Empty the cache; frames of an application that has ended are only forgotten."""
    current = spark or SparkSession.getActiveSession()
    while _cache:
        (application, _), (_, table) = _cache.popitem()
        if current is not None and application == current.sparkContext.applicationId:
            table.unpersist()


def load_artifact(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One artifact table with its columns checked; key columns that are not integers only warn."""
    table = require_columns(load_artifact_cached(spark, _table(folder, name)), ARTIFACT_COLUMNS[name], name)
    for column in table.columns:
        kind = table.schema[column].dataType.simpleString()
        if column.endswith("_id") and kind not in ("bigint", "int", "void"):
            logger.warning("%s.%s has type %s", name, column, kind)
    return table


def get_item_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return load_artifact(spark, folder, "item_metadata")


def get_category_stats(spark: SparkSession, folder: str) -> DataFrame:
    return load_artifact(spark, folder, "category_stats")


def get_category_tree(spark: SparkSession, folder: str) -> DataFrame:
    return load_artifact(spark, folder, "category_tree")


def save_artifact_tables(tables: Mapping[str, DataFrame], folder: str) -> dict[str, str]:
    paths = {}
    for name, table in tables.items():
        paths[name] = _table(folder, name)
        table.write.mode("overwrite").parquet(paths[name])
    return paths


@dataclass(frozen=True)
class ModelArtifacts:
    model: FactorModel
    matrix: UserItemMatrix
    popular: DataFrame
    purchases: DataFrame | None
    params: dict[str, Any]


def save_model_artifacts(
    folder: str,
    model: FactorModel,
    matrix: UserItemMatrix,
    popular: DataFrame,
    params: Mapping[str, Any],
    purchases: DataFrame | None = None,
) -> None:
    """Factors, coordinates, both id mappings and the popular list as tables; parameters and shapes as one JSON row.

    Purchases are written only when there are any.
    """
    tables = {
        "user_factors": model.user_factors,
        "item_factors": model.item_factors,
        "user_item": matrix.coordinates,
        "user_index": matrix.users,
        "item_index": matrix.items,
        "popular": popular,
    }
    if purchases is not None and not purchases.isEmpty():
        tables["user_purchases"] = purchases
    paths = save_artifact_tables(tables, folder)
    spark = popular.sparkSession
    shape = {
        "n_users": spark.read.parquet(paths["user_index"]).count(),
        "n_items": spark.read.parquet(paths["item_index"]).count(),
    }
    save_json(spark, {"params": dict(params), "shape": shape, "has_purchases": "user_purchases" in tables}, f"{folder}/metadata.json")


def load_model_artifacts(spark: SparkSession, folder: str) -> ModelArtifacts:
    metadata = load_json(spark, f"{folder}/metadata.json")

    def read(name: str) -> DataFrame:
        return spark.read.parquet(_table(folder, name))

    return ModelArtifacts(
        model=FactorModel(read("user_factors"), read("item_factors")),
        matrix=UserItemMatrix(read("user_item"), read("user_index"), read("item_index")),
        popular=read("popular"),
        purchases=read("user_purchases") if metadata["has_purchases"] else None,
        params=metadata["params"],
    )


def save_json(spark: SparkSession, value: Mapping[str, Any], path: str) -> None:
    """A small report as one JSON line, on whatever file system the path names."""
    text = json.dumps(value, ensure_ascii=False, sort_keys=True)
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def load_json(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads(spark.read.text(path).first()["value"])


def save_metrics(metrics: DataFrame, path: str) -> None:
    """(metric, value) as one JSON file."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def load_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS_SCHEMA).json(path)


def previous_metrics(spark: SparkSession, path: str) -> DataFrame | None:
    """Saved metrics held in memory, or None when there are none yet; the file may be overwritten afterwards."""
    try:
        rows = load_metrics(spark, path).collect()  # one row per metric
    except AnalysisException:
        return None
    return spark.createDataFrame(rows, METRICS_SCHEMA)
