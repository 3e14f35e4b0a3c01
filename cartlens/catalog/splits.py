"""Decay, filters, sampling, splits and the coordinate matrix."""

from pyspark.sql import functions as F

from cartlens.catalog.registry import query
from cartlens.config import PRODUCTION
from cartlens.operators import features, matrix, splits, transforms

_SHARE = PRODUCTION.test_size


@query(
    "time_decay",
    """
SELECT user_id, item_id, timestamp,
       round(rating * exp(-((SELECT max(timestamp) FROM interactions) - timestamp) / 86400000.0::DOUBLE / 14.0::DOUBLE), 6) AS rating
FROM interactions""",
)
def _(s):
    return transforms.apply_time_decay(s.interactions())


@query(
    "time_decay_long_period",
    """
SELECT user_id, item_id, timestamp,
       round(rating * exp(-(1451606400000 - timestamp) / 86400000.0::DOUBLE / 365.0::DOUBLE), 6) AS rating
FROM interactions""",
)
def _(s):
    return transforms.apply_time_decay(s.interactions(), max_timestamp=1_451_606_400_000, decay_period_days=365.0)


@query(
    "interactions_without_purchases",
    """
SELECT user_id, item_id, rating, timestamp FROM interactions i
WHERE NOT EXISTS (SELECT 1 FROM purchased p WHERE p.user_id = i.user_id AND p.item_id = i.item_id)""",
)
def _(s):
    return transforms.filter_purchased_items(s.interactions(), features.purchases(s.stored_events))


@query(
    "interactions_only_purchases",
    """
SELECT user_id, item_id, rating, timestamp FROM interactions i
WHERE EXISTS (SELECT 1 FROM purchased p WHERE p.user_id = i.user_id AND p.item_id = i.item_id)""",
)
def _(s):
    return transforms.filter_purchased_items(s.interactions(), features.purchases(s.stored_events), "keep")


def _sampled(order: str) -> str:
    return f"""
SELECT timestamp, user_id, item_id, event, transaction_id FROM clean_events WHERE event <> 'view'
UNION ALL
SELECT timestamp, user_id, item_id, event, transaction_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS r FROM clean_events WHERE event = 'view')
WHERE r <= 10"""


@query("subsample_views_last", _sampled("timestamp DESC, item_id"))
def _(s):
    return transforms.subsample_views(s.events, 10, "last")


@query("subsample_views_first", _sampled("timestamp, item_id"))
def _(s):
    return transforms.subsample_views(s.events, 10, "first")


@query(
    "subsample_views_random",
    _sampled("md5(concat_ws('|', '42', CAST(user_id AS VARCHAR), CAST(item_id AS VARCHAR), CAST(timestamp AS VARCHAR)))"),
)
def _(s):
    return transforms.subsample_views(s.events, 10, "random")


def _without_bought(condition: str) -> str:
    return f"""
SELECT r.user_id, r.item_id, r.rank FROM recs r LEFT JOIN item_categories c ON c.item_id = r.item_id
WHERE NOT EXISTS (
  SELECT 1 FROM purchased p JOIN item_categories k ON k.item_id = p.item_id
  WHERE p.user_id = r.user_id AND k.category_id = c.category_id {condition})"""


@query("recs_without_bought_categories", _without_bought(""))
def _(s):
    return transforms.filter_purchased_categories(s.recs, features.purchases(s.stored_events), s.categories)


@query("recs_without_bought_heavy_categories", _without_bought("AND k.category_id IN (103, 107, 111)"))
def _(s):
    return transforms.filter_purchased_categories(s.recs, features.purchases(s.stored_events), s.categories, [103, 107, 111])


@query("split_per_user_train", "SELECT user_id, item_id, rating, timestamp FROM train")
def _(s):
    return s.train


@query("split_per_user_test", "SELECT user_id, item_id, rating, timestamp FROM test")
def _(s):
    return s.test


@query("split_per_user_events_test", "SELECT timestamp, user_id, item_id, event, transaction_id FROM test_events")
def _(s):
    return s.event_split[1]


_GLOBAL_CUT = """
(SELECT timestamp FROM interactions WHERE timestamp IS NOT NULL ORDER BY timestamp LIMIT 1 OFFSET (
  SELECT CAST(greatest(1, least(count(*) - 1, floor(count(*) * (1.0::DOUBLE - 0.15::DOUBLE)))) AS BIGINT)
  FROM interactions WHERE timestamp IS NOT NULL))"""


@query("split_global_train", f"SELECT user_id, item_id, rating, timestamp FROM interactions WHERE timestamp < {_GLOBAL_CUT}")
def _(s):
    return splits.temporal_split_global(s.interactions(), _SHARE)[0]


@query("split_global_test", f"SELECT user_id, item_id, rating, timestamp FROM interactions WHERE timestamp >= {_GLOBAL_CUT}")
def _(s):
    return splits.temporal_split_global(s.interactions(), _SHARE)[1]


_SPAN_CUT = """
(SELECT max(timestamp) - CAST(floor(((max(timestamp) - min(timestamp)) // 86400000) * 0.15::DOUBLE) AS BIGINT) * 86400000
 FROM clean_events)"""


@query("split_by_span_train", f"SELECT user_id, item_id, rating, timestamp FROM interactions WHERE timestamp < {_SPAN_CUT}")
def _(s):
    return splits.global_time_split(s.interactions(), s.stored_events, test_size=_SHARE)[0]


@query("split_by_span_test", f"SELECT user_id, item_id, rating, timestamp FROM interactions WHERE timestamp >= {_SPAN_CUT}")
def _(s):
    return splits.global_time_split(s.interactions(), s.stored_events, test_size=_SHARE)[1]


@query(
    "split_by_date_test",
    "SELECT user_id, item_id, rating, timestamp FROM interactions WHERE timestamp >= epoch_ms(TIMESTAMP '2014-01-01')",
)
def _(s):
    return splits.global_time_split(s.interactions(), s.stored_events, split_date="2014-01-01")[1]


_SECONDS_CUT = """
(SELECT max(timestamp) - CAST(floor((max(timestamp) - min(timestamp)) / 1000.0::DOUBLE * 0.15::DOUBLE) AS BIGINT) * 1000
 FROM clean_events)"""


@query(
    "split_validation_sides",
    f"""
SELECT CASE WHEN timestamp < {_SECONDS_CUT} THEN 'train' ELSE 'validation' END AS side, event, count(*) AS n
FROM clean_events GROUP BY 1, 2""",
)
def _(s):
    from pyspark.sql import functions as F

    before, after = splits.validation_cutoff_split(s.stored_events, _SHARE)
    sides = before.withColumn("side", F.lit("train")).unionByName(after.withColumn("side", F.lit("validation")))
    return sides.groupBy("side", "event").agg(F.count(F.lit(1)).alias("n"))


@query(
    "matrix_coordinates",
    """
SELECT u.user_idx, i.item_idx, t.rating FROM train t
JOIN (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS user_idx FROM (SELECT DISTINCT user_id FROM train)) u USING (user_id)
JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS item_idx FROM (SELECT DISTINCT item_id FROM train)) i USING (item_id)""",
)
def _(s):
    return matrix.build_user_item_matrix(s.train).coordinates


@query(
    "matrix_user_index",
    "SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS user_idx FROM (SELECT DISTINCT user_id FROM train)",
)
def _(s):
    return matrix.build_user_item_matrix(s.train).users


@query(
    "matrix_item_index",
    "SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS item_idx FROM (SELECT DISTINCT item_id FROM train)",
)
def _(s):
    return matrix.build_user_item_matrix(s.train).items


@query(
    "matrix_sparsity",
    """
SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, count(*) AS n_events,
       round((1.0::DOUBLE - count(*) / (count(DISTINCT user_id)::DOUBLE * count(DISTINCT item_id))) * 100.0, 6) AS sparsity_pct
FROM clean_events""",
)
def _(s):
    return matrix.sparsity(s.events)


@query(
    "split_hot_hour",
    """
SELECT user_id, item_id, timestamp, event, transaction_id, r <= greatest(1.0::DOUBLE, floor(n * (1.0::DOUBLE - 0.15::DOUBLE))) AS is_train
FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n,
             row_number() OVER (PARTITION BY user_id ORDER BY timestamp, item_id, event, transaction_id NULLS FIRST) AS r
      FROM (SELECT CASE item_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE user_id END AS user_id, item_id,
                   CASE WHEN item_id % 3 = 1 THEN 1400000000000 + timestamp % 1800000 ELSE timestamp END AS timestamp, event, transaction_id
            FROM clean_events))""",
)
def _(s):
    """A third of all events without a user, and a third by one user within half an hour, against the plain window."""
    kind = F.col("item_id") % 3
    skewed = s.stored_events.select(
        F.when(kind == 1, F.lit(1).cast("bigint")).when(kind == 2, F.col("user_id")).alias("user_id"),
        "item_id",
        F.when(kind == 1, F.lit(1_400_000_000_000) + F.col("timestamp") % 1_800_000).otherwise(F.col("timestamp")).alias("timestamp"),
        "event",
        "transaction_id",
    )
    return splits.mark_split_per_user(skewed, _SHARE, ("item_id", "event", "transaction_id"), heavy_rows=2000)
