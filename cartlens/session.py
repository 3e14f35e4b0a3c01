"""Session set-up shared by jobs, tests and the benchmark."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators rely on for right results.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # Recursive category walks are bounded by depth, so the default row limit must not cut them short.
    "spark.sql.cteRecursionRowLimit": "-1",
}

_FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    for key, value in REQUIRED_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, app: str = "cartlens", memory: str = "16g") -> SparkSession:
    """A single-machine session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores if str(cores).isdigit() else 8))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``, else a local one for tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = os.path.join(tempfile.gettempdir(), "cartlens-stages")
    return folder


_run: ContextVar[str | None] = ContextVar("run", default=None)


def cleans_up(job: Callable) -> Callable:
    """Let a job stage its frames in a folder of its own, and remove that folder when the job has ended, well or not.

    For jobs that have written or collected all they return. A job called by another one uses the caller's folder.
    """

    @functools.wraps(job)
    def run(spark: SparkSession, *args, **kwargs):
        if _run.get():
            return job(spark, *args, **kwargs)
        folder = f"{shared_folder(spark).rstrip('/')}/cartlens/run-{uuid.uuid4().hex}"
        token = _run.set(folder)
        try:
            return job(spark, *args, **kwargs)
        finally:
            _run.reset(token)
            remove(spark, folder)

    return run


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder on any file system Spark can write."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def local_stages(spark: SparkSession) -> str | None:
    """The folder of staged files as Python workers open it, or None where only Spark can."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_stages(spark))
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def ship_package(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver has it; clusters get it by --py-files."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([*paths, root])


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Let what runs inside remove its shuffle files at its end, which otherwise stay until the driver's memory fills up.

    For writes, whose shuffles nothing reads again.
    """
    before = spark.conf.get(_FILE_CLEANUP, None)
    spark.conf.set(_FILE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FILE_CLEANUP) if before is None else spark.conf.set(_FILE_CLEANUP, before)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several branches read the same expensive result. The files outlive lost executors, cut the lineage,
    and unlike a row checkpoint keep column pruning and filter pushdown for the readers.
    """
    return stage_at(df, label)[0]


def stage_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Like ``stage``, with the folder, for loops that remove what they have read for the last time."""
    return _write(df, label, _stages(df.sparkSession))


def _stages(spark: SparkSession) -> str:
    return _run.get() or f"{shared_folder(spark).rstrip('/')}/cartlens"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Stage what runs inside in a folder that is removed at the end; the function given stages what is to be kept.

    For steps that have written all they return. What is read later must have been staged before or be kept.
    """
    outer = _stages(spark)
    folder = f"{outer}/scratch-{uuid.uuid4().hex}"
    token = _run.set(folder)
    try:
        yield lambda df, label: _write(df, label, outer)[0]
    finally:
        _run.reset(token)
        remove(spark, folder)


def _write(df: DataFrame, label: str, folder: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path
