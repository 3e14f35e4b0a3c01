"""Joins with a table of few rows per key whose size is looked at first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which the small side goes to every task: some ten megabytes of short rows.
BROADCAST_ROWS = 100_000
_SALTS = 32


def join_small(df: DataFrame, small: DataFrame, keys: Sequence[str], spread: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys with a stored table that has one row per key, whatever share of ``df`` one key holds.

    Up to BROADCAST_ROWS rows the table is broadcast. Beyond, each of its rows is repeated for a few salts, and the rows
    of ``df`` choose theirs by the hash of the spread columns, so a hot key meets several tasks.
    """
    if small.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(small), list(keys), how)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(_SALTS)))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")
