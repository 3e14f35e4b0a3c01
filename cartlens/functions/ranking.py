"""Ranking, positions and order statistics that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlens.functions.joins import join_small
from cartlens.session import stage

_PLACE_MASK = (1 << 33) - 1  # monotonically_increasing_id keeps the row's place in its lower 33 bits
# Above this limit Spark no longer trims groups ahead of the shuffle (spark.sql.optimizer.windowGroupLimitThreshold).
_GROUP_LIMIT_THRESHOLD = 1000
_SALTS = 64
# Ranges of rows of heavy keys: so many at most, unless they would be longer than half of this.
_FEW_PARTS, _PART_ROWS = 256, 1_000_000


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None
) -> DataFrame:
    """First ``n`` rows of every group, optionally with their 1-based position.

    ``row_number() <= n`` lets Spark keep only n rows per group in every map task before the shuffle, so a hot group
    shuffles at most n rows per task. Larger n gets the same effect from a salted first pass.
    """
    position = rank or "_pos"
    if n > _GROUP_LIMIT_THRESHOLD:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(_SALTS)))
        first = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn("_first", F.row_number().over(first)).filter(F.col("_first") <= n).drop("_salt", "_first")
    ranked = df.withColumn(position, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(position) <= n)
    return kept if rank else kept.drop(position)


def positions_in_time(
    df: DataFrame,
    key: str,
    ts: str,
    ties: Sequence[str],
    heavy_rows: int = 1_000_000,
    at_most: DataFrame | None = None,
) -> DataFrame:
    """Adds ``_n`` (rows of the key, null times included) and ``_r`` (1-based place by time) to rows with a time.

    Keys up to ``heavy_rows`` rows, the null key among them, share one window and one shuffle. The rows of heavier keys
    are cut into ranges of (key, time, ties), see ``_ranged_positions``, so no task sorts a whole key. Rows that agree in
    all of these get their places by the hash of the other columns; what then still agrees are equal rows.

    ``at_most`` (key, _n) bounds the rows of every key from above, if that is known without reading ``df``. Where it tells
    that no key is heavy, ``df`` is read once and keeps a partitioning by the key that it may have.
    """
    by_key = Window.partitionBy(key)
    place = by_key.orderBy(F.asc_nulls_last(ts), *ties)

    def light(rows: DataFrame) -> DataFrame:
        ranked = rows.withColumn("_r", F.row_number().over(place).cast("bigint"))
        return ranked.withColumn("_n", F.count(F.lit(1)).over(by_key)).filter(F.col(ts).isNotNull())

    if at_most is not None:
        if stage(at_most.filter(F.col("_n") > heavy_rows).select(key), "heavy-at-most").isEmpty():
            return light(df)
        df = stage(df, "placed")
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    heavy = stage(_keyed(sizes.filter(F.col("_n") > heavy_rows), key).select("_key", "_null", "_n"), "heavy-keys")
    if heavy.isEmpty():
        return light(df)
    marked = join_small(_keyed(df, key), heavy, ["_key", "_null"], [key, ts, *ties], "left")
    few = marked.filter("_n IS NULL").select(*df.columns)
    many = _ranged_positions(marked.filter("_n IS NOT NULL"), df.columns, ts, ties, heavy_rows)
    return light(few).select(*df.columns, "_n", "_r").unionByName(many.select(*df.columns, "_n", "_r"))


def _keyed(df: DataFrame, key: str) -> DataFrame:
    """With the key as two columns that are never null, so that null keys meet in a join."""
    nothing = F.lit("0").cast(df.schema[key].dataType)
    return df.withColumn("_key", F.coalesce(F.col(key), nothing)).withColumn("_null", F.col(key).isNull())


def _range_parts(rows: int, limit: int) -> int:
    """Parts of about half of ``limit`` rows, as long as there are few of them; beyond, of half a million rows.

    Each part is a task that reports to the driver, so their number must not follow the rows where the limit is low.
    """
    wanted = -(-2 * rows // limit)
    return max(1, min(wanted, max(_FEW_PARTS, -(-2 * rows // _PART_ROWS))))


def _ranged_positions(df: DataFrame, columns: Sequence[str], ts: str, ties: Sequence[str], limit: int) -> DataFrame:
    """Places of the rows of heavy keys, which carry _key, _null and _n.

    Equal rows shrink to one with their number before any shuffle by range. The rest is dealt by ranges of (key, time,
    ties, hash of the row) into parts, see ``_range_parts``; a place is what stands before it in its part, plus the
    key's rows in earlier parts. At last equal rows take consecutive places, at most ``limit`` of them in one task.
    """
    order = ["_key", "_null", ts, *ties, "_hash"]
    counted = (
        df.filter(F.col(ts).isNotNull())
        .groupBy(*df.columns)
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_hash", F.xxhash64(*columns))
    )
    counted = stage(counted, "heavy-rows")
    parts = _range_parts(counted.count(), limit)
    dealt = stage(counted.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "heavy-ranges")
    whole = ["_key", "_null"]
    before = Window.partitionBy(*whole).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    offsets = stage(
        dealt.groupBy(*whole, "_part")
        .agg(F.sum("_c").alias("_s"))
        .select(*whole, "_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off")),
        "heavy-offsets",
    )
    inside = Window.partitionBy("_part", *whole).orderBy(ts, *ties, "_hash").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.withColumn("_at", F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    placed = join_small(first, offsets, [*whole, "_part"], ["_hash"])
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_c") - 1) / limit)))
    spread = placed.withColumn("_run", runs)
    long_runs = spread.filter(F.col("_c") > limit).repartition("_hash", "_run")
    single = F.sequence(F.col("_run") * limit + 1, F.least(F.col("_c"), (F.col("_run") + 1) * limit))
    return (
        spread.filter(F.col("_c") <= limit)
        .unionByName(long_runs)
        .withColumn("_i", F.explode(single))
        .withColumn("_r", F.col("_off") + F.col("_at") + F.col("_i"))
    )


def dense_index(ids: DataFrame, key: str, index: str = "idx") -> DataFrame:
    """0-based dense index of distinct ids in ascending order.

    A range sort spreads the ids evenly whatever their values; each row keeps its partition and its place there. The
    result is written, so partition and place are settled, and the index adds the sizes of the earlier partitions:
    a running sum over one row per partition.
    """
    ordered = ids.select(key).filter(F.col(key).isNotNull()).distinct().sort(key)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE_MASK))
    placed = stage(ordered.select(key, F.spark_partition_id().alias("_part"), place.alias("_place")), f"index-{key}")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_off"))
    return placed.join(F.broadcast(offsets), "_part").select(key, (F.col("_place") + F.col("_off")).alias(index))


def value_at_position(df: DataFrame, column: str, position: Column, width: int = 3_600_000) -> DataFrame:
    """At most one row ``value``: the element of a long column at a 0-based position of its sorted order.

    ``position`` is a column over ``n``, the count of non-null values. Counts per bucket of ``width`` find the bucket
    holding the position, then counts per value inside that bucket find the value. Both ladders are short: hours of
    the time range, and milliseconds of one hour.
    """
    values = df.select(F.col(column).cast("long").alias("_v")).filter(F.col("_v").isNotNull())
    bucket = F.floor(F.col("_v") / F.lit(width))
    everything = Window.partitionBy(F.lit(0))
    running = everything.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    buckets = values.groupBy(bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    home = (
        buckets.withColumn("_end", F.sum("_c").over(running))
        .withColumn("n", F.sum("_c").over(everything))
        .withColumn("_k", position.cast("long"))
        .filter((F.col("_end") > F.col("_k")) & (F.col("_end") - F.col("_c") <= F.col("_k")))
        .select("_b", (F.col("_k") - F.col("_end") + F.col("_c")).alias("_k"))
    )
    inside = (
        values.withColumn("_b", bucket)
        .join(F.broadcast(home), "_b")  # one row
        .groupBy("_v", "_k")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    upto = everything.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    return (
        inside.withColumn("_end", F.sum("_c").over(upto))
        .filter((F.col("_end") > F.col("_k")) & (F.col("_end") - F.col("_c") <= F.col("_k")))
        .select(F.col("_v").alias("value"))
    )


def nearest_rank_quantiles(counts: DataFrame, column: str, quantiles: dict[str, float]) -> DataFrame:
    """One row with the nearest-rank quantiles of an integer column: the element at round(q * (n - 1)).

    Works on (value, frequency): a column of per-key counts that sum to N has at most sqrt(2 N) distinct values.
    """
    freq = counts.groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_f"))
    upto = Window.partitionBy(F.lit(0)).orderBy("_v")
    ladder = freq.withColumn("_end", F.sum("_f").over(upto.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "_n", F.sum("_f").over(Window.partitionBy(F.lit(0)))
    )
    return ladder.agg(
        *[
            F.min(F.when(F.col("_end") > F.round(F.lit(q) * (F.col("_n") - 1)), F.col("_v"))).alias(name)
            for name, q in quantiles.items()
        ]
    )
