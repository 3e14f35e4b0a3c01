"""A dashboard table that a stream replaces row by row, the same after any repeated batch.

Every batch leaves its changed rows in a folder named after the batch, so a batch that runs again overwrites itself. The
current table is the newest row of every key. ``compact`` folds old batches into one, for streams that run for long.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.session import exists, remove


def publisher(folder: str) -> Callable[[DataFrame, int], None]:
    """For ``monitors.write_dashboard``."""

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={batch_id}")

    return publish


def _newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_row"), F.max("batch").alias("batch"))
    return last.select(*keys, "_row.*", "batch")


def _parts(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The newest base, and the batches after it."""
    rows = spark.read.schema(f"{schema}, batch bigint").parquet(f"{folder}/changes")
    if exists(spark, f"{folder}/base"):
        bases = spark.read.schema(f"{schema}, batch bigint, upto bigint").parquet(f"{folder}/base")
        upto = bases.agg(F.max("upto").alias("u")).first()["u"]
        if upto is not None:
            rows = rows.filter(F.col("batch") > upto).unionByName(bases.filter(F.col("upto") == upto).drop("upto"))
    return rows


def current(spark: SparkSession, folder: str, keys: Sequence[str], schema: str) -> DataFrame:
    return _newest(_parts(spark, folder, schema), keys).drop("batch")


def compact(spark: SparkSession, folder: str, keys: Sequence[str], schema: str) -> int:
    """Fold all batches but the last, which may still run again, into a new base; returns the number up to which."""
    batches = spark.read.schema(f"{schema}, batch bigint").parquet(f"{folder}/changes")
    done = sorted(r["batch"] for r in batches.select("batch").distinct().collect())[:-1]  # one row per batch since the last call
    if done:
        rows = _parts(spark, folder, schema).filter(F.col("batch") <= done[-1])
        _newest(rows, keys).write.mode("overwrite").parquet(f"{folder}/base/upto={done[-1]}")
        for batch in done:
            remove(spark, f"{folder}/changes/batch={batch}")
    return done[-1] if done else -1
