"""DataFrame helpers of the operators: input tables, added columns, held-out rows."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


BATCH_ROWS = 1000


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver has it; clusters get it by --py-files.

    Rows here hold whole texts or arrays, so no more than BATCH_ROWS of them go to a worker at once.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([*paths, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def schema_with(docs: DataFrame, added: list[tuple[str, T.DataType]]) -> T.StructType:
    """The frame's columns except those of the added names, then the added ones."""
    new = {name for name, _ in added}
    kept = [f for f in docs.schema.fields if f.name not in new]
    return T.StructType([*kept, *(T.StructField(name, kind) for name, kind in added)])


def held_out(modulus: int, remainder: int, id_col: str = "doc_id"):
    """Whether crc32 of the id as text has the remainder; a null id counts as not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def set_aside(docs: DataFrame, *reserved: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The frame with clashing columns under other names, and a function that gives them their names back."""
    other = {}
    for name in reserved:
        if name in docs.columns:
            away = f"{name}_"
            while away in docs.columns or away in other.values() or away in reserved:
                away += "_"
            other[name] = away
    return docs.withColumnsRenamed(other), lambda df: df.withColumnsRenamed({away: name for name, away in other.items()})
