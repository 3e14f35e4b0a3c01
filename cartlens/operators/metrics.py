"""Offline quality metrics. Each function returns a one-row frame; empty input gives 0."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metrics a release is checked on.
KEY_METRICS = (
    "precision@5",
    "precision@10",
    "recall@10",
    "recall@20",
    "ndcg@10",
    "hit_rate@5",
    "hit_rate@10",
)
MIN_TARGET_PAIRS = 100


def _check_k(k: int) -> None:
    if k <= 0:
        raise ValueError("k must be positive")


def _or_zero(value: Column) -> Column:
    return F.coalesce(F.when(~F.isnan(value), value), F.lit(0.0))


def _ideal_gain(relevant: Column, k: int) -> Column:
    """Sum of 1 / log2(i + 1) over the first min(relevant, k) places, from a table of k constants."""
    total, sums = 0.0, []
    for place in range(1, k + 1):
        total += 1.0 / math.log2(place + 1)
        sums.append(total)
    return F.element_at(F.array(*[F.lit(s) for s in sums]), F.least(relevant, F.lit(k)).cast("int"))


def user_hits(test: DataFrame, recs: DataFrame, ks: tuple[int, ...], carts: DataFrame | None = None) -> DataFrame:
    """One row per user with a list or test items: list flag, hits and gain for every k, and test item count.

    The list meets the test pairs once, at the largest k; every smaller k is a conditional sum over the same rows.
    With ``carts``, further pairs that the list meets in the same join, there are ``cart_hits_k`` too.
    """
    if carts is None:
        pairs = test.select("user_id", "item_id").distinct()
        relevant = pairs.groupBy("user_id").agg(F.count(F.lit(1)).alias("relevant"))
        pairs = pairs.withColumn("_rel", F.lit(1))
    else:
        marked = lambda side, rel: side.select("user_id", "item_id", F.lit(rel).alias("_rel"), F.lit(1 - rel).alias("_cart"))
        either = marked(test, 1).unionByName(marked(carts, 0)).groupBy("user_id", "item_id")
        pairs = either.agg(F.max("_rel").alias("_rel"), F.max("_cart").alias("_cart"))
        relevant = pairs.groupBy("user_id").agg(F.nullif(F.sum("_rel"), F.lit(0).cast("bigint")).alias("relevant"))
    listed = recs.filter((F.col("rank") <= max(ks)) & F.col("user_id").isNotNull()).select("user_id", "item_id", "rank")
    judged = listed.join(pairs, ["user_id", "item_id"], "left")
    rel = F.coalesce("_rel", F.lit(0))
    sums = []
    for k in ks:
        inside = F.col("rank") <= k
        sums += [
            F.max(F.when(inside, F.lit(1)).otherwise(F.lit(0))).alias(f"listed_{k}"),
            F.sum(F.when(inside, rel).otherwise(F.lit(0))).alias(f"hits_{k}"),
            F.sum(F.when(inside, rel / F.log2(F.col("rank") + 1)).otherwise(F.lit(0.0))).alias(f"gain_{k}"),
        ]
        if carts is not None:
            sums.append(F.sum(F.when(inside, F.coalesce("_cart", F.lit(0))).otherwise(F.lit(0))).alias(f"cart_hits_{k}"))
    per_user = judged.groupBy("user_id").agg(*sums)
    return per_user.join(relevant, "user_id", "full")


def _quality(k: int) -> dict[str, Column]:
    common = (F.col(f"listed_{k}") == 1) & F.col("relevant").isNotNull()
    hits, relevant = F.col(f"hits_{k}"), F.col("relevant")
    gain = F.col(f"gain_{k}") / _ideal_gain(relevant, k)
    return {
        "precision": _or_zero(F.avg(F.when(common, hits / F.lit(float(k))))),
        "recall": _or_zero(F.avg(F.when(common, hits / relevant))),
        "ndcg": F.greatest(F.least(_or_zero(F.avg(F.when(common, gain))), F.lit(1.0)), F.lit(0.0)),
        "hit_rate": _or_zero(
            F.count(F.when(hits > 0, F.lit(1))) / F.nullif(F.count("relevant"), F.lit(0).cast("bigint"))
        ),
    }


def precision_recall_ndcg_at_k(test: DataFrame, recs: DataFrame, k: int) -> DataFrame:
    """Means over users present in both the lists at k and the test pairs."""
    _check_k(k)
    q = _quality(k)
    return user_hits(test, recs, (k,)).agg(
        q["precision"].alias("precision@k"), q["recall"].alias("recall@k"), q["ndcg"].alias("ndcg@k")
    )


def hit_rate_at_k(test: DataFrame, recs: DataFrame, k: int) -> DataFrame:
    """Users with a hit over all test users."""
    _check_k(k)
    return user_hits(test, recs, (k,)).agg(_quality(k)["hit_rate"].alias("hit_rate@k"))


def _at_k(recs: DataFrame, k: int) -> DataFrame:
    _check_k(k)
    return recs.filter((F.col("rank") <= k) & F.col("item_id").isNotNull())


def _coverage(shown: Column, catalog_size: int | DataFrame) -> Column:
    if isinstance(catalog_size, int) and catalog_size <= 0:
        raise ValueError("catalog_size must be positive")
    size = F.lit(catalog_size) if isinstance(catalog_size, int) else F.lit(catalog_size.scalar())
    return F.least(shown / size, F.lit(1.0)).alias("coverage@k")


def coverage_at_k(recs: DataFrame, catalog_size: int | DataFrame, k: int) -> DataFrame:
    """Share of the catalogue that appears in the lists; the size may be a one-value frame."""
    return _at_k(recs, k).agg(_coverage(F.count_distinct("item_id"), catalog_size))


def item_counts(train: DataFrame) -> DataFrame:
    """(item_id, n): training rows of each item."""
    return train.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


def _shown_items(recs: DataFrame, counts: DataFrame, k: int) -> tuple[DataFrame, Column]:
    """One row per listed item, and the mean novelty over its list rows."""
    listed = _at_k(recs, k).groupBy("item_id").agg(F.count(F.lit(1)).alias("_rows"))
    total = counts.agg(F.sum("n").cast("double").alias("n")).select(F.nullif("n", F.lit(0.0))).scalar()
    info = -F.log2(F.coalesce("_count", F.lit(1)).cast("double") / total)
    mean = F.sum(F.col("_rows") * info) / F.sum("_rows")
    seen = counts.select("item_id", F.col("n").alias("_count"))
    return listed.join(seen, "item_id", "left"), _or_zero(mean).alias("novelty@k")


def novelty_at_k(recs: DataFrame, train: DataFrame, k: int) -> DataFrame:
    """Mean of -log2(share of training rows) over list rows; an unknown item counts one row.

    List rows are counted per item before meeting the item counts: popular items fill many lists.
    """
    shown, mean = _shown_items(recs, item_counts(train), k)
    return shown.agg(mean)


def coverage_and_novelty(recs: DataFrame, catalog_size: int | DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """Both from one count of the list rows per item; ``counts`` are ``item_counts``."""
    shown, mean = _shown_items(recs, counts, k)
    return shown.agg(_coverage(F.count("item_id"), catalog_size), mean)


def diversity_at_k(recs: DataFrame, metadata: DataFrame, k: int) -> DataFrame:
    """Mean number of distinct categories per user with a categorised item."""
    _check_k(k)
    known = metadata.select("item_id", "category_id").filter(F.col("category_id").isNotNull())
    per_user = (
        _at_k(recs, k).join(known, "item_id").select("user_id", "category_id").distinct().groupBy("user_id").count()
    )
    return per_user.agg(_or_zero(F.avg("count")).alias("diversity@k"))


def cart_prediction_rate(test_events: DataFrame, recs: DataFrame, k: int) -> DataFrame:
    """Users with a listed item in their cart events over users with a list."""
    _check_k(k)
    return user_hits(_carts(test_events), recs, (k,)).agg(_cart_rate(k, "hits").alias("cart_prediction_rate@k"))


def _carts(test_events: DataFrame) -> DataFrame:
    return test_events.filter(F.col("event") == "addtocart")


def _cart_rate(k: int, hits: str = "cart_hits") -> Column:
    with_hit = F.count(F.when(F.col(f"{hits}_{k}") > 0, F.lit(1)))
    with_list = F.count(F.when(F.col(f"listed_{k}") == 1, F.lit(1)))
    return _or_zero(with_hit / F.nullif(with_list, F.lit(0).cast("bigint")))


def compute_all_metrics(
    test: DataFrame,
    recs: DataFrame,
    train: DataFrame,
    catalog_size: int | DataFrame,
    eval_k: int = 5,
    metadata: DataFrame | None = None,
    target: DataFrame | None = None,
    test_events: DataFrame | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """(metric, value). Quality comes from the target pairs, else from all test pairs.

    Quality and cart rate share one join of the lists, coverage and novelty one count of their items. ``counts`` are
    written ``item_counts`` of the training rows, if there are any.
    """
    _check_k(eval_k)
    ks = tuple(sorted({5, 10, 20, 50, eval_k}))
    carts = None if test_events is None else _carts(test_events)
    hits = user_hits(test if target is None else target, recs, ks, carts)
    # Reported names; the last six complete the release check.
    wanted = [
        ("recall@20", 20, "recall"),
        ("precision@5", 5, "precision"),
        ("ndcg@10", 10, "ndcg"),
        ("hit_rate@5", 5, "hit_rate"),
        ("recall@50", 50, "recall"),
        ("precision@k", eval_k, "precision"),
        ("recall@k", eval_k, "recall"),
        ("ndcg@k", eval_k, "ndcg"),
        ("hit_rate@k", eval_k, "hit_rate"),
        ("precision@10", 10, "precision"),
        ("recall@10", 10, "recall"),
        ("hit_rate@10", 10, "hit_rate"),
    ]
    of_users = [_quality(k)[kind].alias(name) for name, k, kind in wanted]
    if carts is not None:
        of_users.append(_cart_rate(5).alias("cart_prediction_rate@5"))
    quality = hits.agg(*of_users)
    singles = [coverage_and_novelty(recs, catalog_size, item_counts(train) if counts is None else counts, eval_k)]
    if metadata is not None:
        singles.append(diversity_at_k(recs, metadata, eval_k))
    out = as_rows(quality)
    for one in singles:
        out = out.unionByName(as_rows(one))
    return out


def as_rows(one_row: DataFrame) -> DataFrame:
    """A one-row frame of metrics as (metric, value)."""
    cells = [F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in one_row.columns]
    return one_row.select(F.inline(F.array(*cells)))


def check_degradation(current: DataFrame, previous: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Key metrics that fell by more than the threshold, where both sides have them and the old value is positive."""
    old = previous.select("metric", F.col("value").alias("previous"))
    change = (F.col("current") - F.col("previous")) / F.col("previous")
    return (
        current.select("metric", F.col("value").alias("current"))
        .filter(F.col("metric").isin(*KEY_METRICS))
        .join(old, "metric")
        .filter(F.col("previous") > 0)
        .withColumn("change", change)
        .filter(F.col("change") < F.lit(-float(threshold)))
        .withColumn("change_pct", F.col("change") * 100.0)
    )


class ModelDegradation(ValueError):
    """The new model is worse than the previous one on a key metric."""


def degradation_gate(degraded: DataFrame, target: DataFrame, least_pairs: int = MIN_TARGET_PAIRS) -> bool:
    """True when the check is clean, False when degraded on too few pairs to block, raises otherwise."""
    rows = degraded.collect()  # one row per key metric at most
    if not rows:
        return True
    if target.limit(least_pairs).count() < least_pairs:
        return False
    names = ", ".join(f"{r['metric']} {r['change_pct']:.1f}%" for r in rows)
    raise ModelDegradation(f"degraded: {names}")


def gate_status(degraded: DataFrame, target: DataFrame, least_pairs: int = MIN_TARGET_PAIRS) -> DataFrame:
    """One row: degraded metrics, target pairs, and whether the gate blocks the release."""
    pairs = target.agg(F.count(F.lit(1))).scalar()
    return degraded.agg(F.count(F.lit(1)).alias("degraded_metrics")).select(
        "degraded_metrics",
        F.lit(pairs).alias("target_pairs"),
        ((F.col("degraded_metrics") > 0) & (F.lit(pairs) >= least_pairs)).alias("blocked"),
    )


def compare_experiments(model: DataFrame, baseline: DataFrame) -> DataFrame:
    """(metric, model, baseline, change_pct) for metrics in both; null change where the baseline is 0."""
    return (
        model.select("metric", F.col("value").alias("model"))
        .join(baseline.select("metric", F.col("value").alias("baseline")), "metric")
        .withColumn(
            "change_pct", F.when(F.col("baseline") != 0, (F.col("model") / F.col("baseline") - 1.0) * 100.0)
        )
    )


def tracking_names(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("metric", F.replace("metric", F.lit("@"), F.lit("_")))
