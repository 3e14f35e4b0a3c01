"""Streaming monitors over the request and event log.

The aggregates are the batch operators; this module adds the source, the watermark and the sinks. All state is
built-in windowed aggregation: a fixed number of counters per open window.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cartlens.operators import abtest, monitoring
from cartlens.session import shared_folder

WATERMARK = "10 minutes"
LOG_SCHEMA = (
    "ts timestamp, user_id bigint, item_id bigint, event string, revenue double, model_type string, status int, "
    "endpoint string, latency_s double, cold boolean, n_recs bigint"
)
POSTED_SCHEMA = "user_id bigint, item_id bigint, event_type string, revenue double, model_type string"


def read_log(spark: SparkSession, folder: str, file_format: str = "parquet", max_files: int | None = None) -> DataFrame:
    """The monitoring log from files as they arrive."""
    reader = spark.readStream.schema(LOG_SCHEMA).format(file_format)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder)


def watermarked(log: DataFrame, delay: str = WATERMARK) -> DataFrame:
    return log.withWatermark("ts", delay)


def request_rates(log: DataFrame, **options) -> DataFrame:
    return monitoring.request_rates(watermarked(log), **options)


def business_rates(log: DataFrame, **options) -> DataFrame:
    return monitoring.business_rates(watermarked(log), **options)


def errors_by_status(log: DataFrame, **options) -> DataFrame:
    return monitoring.errors_by_status(watermarked(log), **options)


def cold_user_rate(log: DataFrame, **options) -> DataFrame:
    return monitoring.cold_user_rate(watermarked(log), **options)


def latency_quantiles(log: DataFrame, **options) -> DataFrame:
    return monitoring.latency_quantiles(watermarked(log), **options)


def approximate_latency(log: DataFrame, **options) -> DataFrame:
    return monitoring.approximate_latency(watermarked(log), **options)


def recommendation_count_quantiles(log: DataFrame, **options) -> DataFrame:
    return monitoring.recommendation_count_quantiles(watermarked(log), **options)


def event_counters(log: DataFrame) -> DataFrame:
    """Running totals; use complete or update mode. Three groups of state in all."""
    return monitoring.event_counters(log)


def requests_by_model(log: DataFrame) -> DataFrame:
    return monitoring.requests_by_model(log)


def minute_counts(log: DataFrame) -> DataFrame:
    """Closed minutes with the counts alerts are judged on; ``monitoring.alerts`` reads the written minutes."""
    return monitoring.minute_windows(watermarked(log))


def checkpoint_of(path: str) -> str:
    """Where a query that writes to ``path`` keeps its progress: next to its output, the same for every start.

    The output remembers which batches it has, so it must never be written with the progress of another run.
    """
    return f"{path.rstrip('/')}.checkpoint"


def _new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/cartlens/stream-{name}-{uuid.uuid4().hex}"


def write_closed_windows(
    result: DataFrame, path: str, checkpoint: str | None = None, available_now: bool = False, every: str = "1 minute"
) -> StreamingQuery:
    """Append each window to parquet once the watermark has closed it; a restart goes on where the last run ended."""
    writer = (
        result.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint or checkpoint_of(path))
    )
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def write_dashboard(
    result: DataFrame,
    publish: Callable[[DataFrame, int], None],
    checkpoint: str,
    every: str = "10 seconds",
    available_now: bool = False,
) -> StreamingQuery:
    """Hand changed windows to ``publish(batch, batch_id)`` in update mode, for sinks that replace rows by key."""
    writer = result.writeStream.outputMode("update").foreachBatch(publish).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def split_business_events(
    posted: DataFrame, accepted_path: str, rejected_path: str, available_now: bool = False
) -> tuple[StreamingQuery, StreamingQuery]:
    """Valid business events to one folder, the rest to a reject folder; each keeps its progress next to its output."""
    accepted, rejected = abtest.business_events(posted)
    return (
        write_closed_windows(accepted, accepted_path, available_now=available_now),
        write_closed_windows(rejected, rejected_path, available_now=available_now),
    )


def run_available(result: DataFrame, name: str) -> DataFrame:
    """Run a stream over all files present now and read back its closed windows."""
    spark = result.sparkSession
    path = _new_path(spark, f"{name}-out")
    query = write_closed_windows(result, path, available_now=True)
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(path)


def run_available_totals(result: DataFrame, name: str) -> DataFrame:
    """Same for running totals: complete mode into a table of a handful of rows."""
    spark = result.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    query = (
        result.writeStream.outputMode("complete")
        .format("memory")
        .queryName(table)
        .option("checkpointLocation", _new_path(spark, name))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.table(table)
