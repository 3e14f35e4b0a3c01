"""Weights, interactions, catalogue metadata, purchases and sizes."""

from pyspark.sql import functions as F

from cartlens.catalog.registry import query
from cartlens.config import PRODUCTION, InteractionConfig
from cartlens.operators import features as f


@query("event_weights", "SELECT event, event_weight, count(*) AS n FROM weighted_events GROUP BY 1, 2")
def _(s):
    return f.weighted_events(s.events).groupBy("event", "event_weight").agg(F.count(F.lit(1)).alias("n"))


@query("interactions_production", "SELECT user_id, item_id, rating, timestamp FROM interactions")
def _(s):
    return f.build_interactions(s.events, PRODUCTION.interactions)


@query(
    "interactions_strict",
    """
SELECT user_id, item_id, rating, timestamp FROM (
  SELECT *, count(*) OVER (PARTITION BY user_id) AS u, count(*) OVER (PARTITION BY item_id) AS i FROM all_pairs)
WHERE u >= 30 AND i >= 25""",
)
def _(s):
    return f.build_interactions(s.events, InteractionConfig(min_user_interactions=30, min_item_interactions=25))


@query("latest_categories", "SELECT item_id, category_id FROM item_categories")
def _(s):
    return s.categories


@query("item_availability", "SELECT item_id, available_value FROM item_available")
def _(s):
    return f.item_availability(s.properties)


@query("category_depth", "SELECT category_id, level FROM tree_levels")
def _(s):
    return f.category_levels(s.tree)


@query(
    "category_depth_orphans_as_roots",
    """
SELECT t.category_id, coalesce(l.level, CASE WHEN o.category_id IS NOT NULL THEN 2 END) AS level
FROM clean_tree t LEFT JOIN tree_levels l ON l.category_id = t.category_id
LEFT JOIN (SELECT category_id FROM clean_tree c WHERE parent_id IS NOT NULL
             AND NOT EXISTS (SELECT 1 FROM clean_tree p WHERE p.category_id = c.parent_id)) o
  ON o.category_id = t.category_id""",
)
def _(s):
    return f.category_levels(s.tree, orphan_as_root=True)


@query("category_tree_levels", "SELECT category_id, parent_id, level FROM tree_levels")
def _(s):
    return f.tree_with_levels(s.tree)


@query("category_stats", "SELECT category_id, n_events, n_users, n_items FROM cat_stats")
def _(s):
    return f.category_stats(s.events, s.categories)


@query(
    "item_popularity",
    "SELECT item_id, n_events, n_users, round(weighted_score, 6) AS weighted_score FROM item_pop",
)
def _(s):
    return f.item_popularity(s.events)


_METADATA = """
SELECT c.item_id, c.category_id, l.level, a.available_value, coalesce(p.n_events, 0) AS n_events,
       coalesce(p.n_users, 0) AS n_users, round(coalesce(p.weighted_score, 0.0), 6) AS weighted_score
FROM item_categories c LEFT JOIN tree_levels l ON l.category_id = c.category_id
LEFT JOIN item_available a ON a.item_id = c.item_id LEFT JOIN item_pop p ON p.item_id = c.item_id"""


@query("item_metadata", _METADATA)
def _(s):
    return f.item_metadata(
        s.categories, f.category_levels(s.tree), f.item_availability(s.properties), f.item_popularity(s.events)
    )


@query("purchases", "SELECT user_id, item_id FROM purchased")
def _(s):
    return f.purchases(s.events)


@query("purchases_per_user", "SELECT user_id, count(*) AS n_purchased FROM purchased GROUP BY 1")
def _(s):
    return f.purchase_counts(f.purchases(s.events))


@query("target_pairs", "SELECT user_id, item_id, rating, timestamp FROM targets")
def _(s):
    return s.targets


@query("user_history_categories", "SELECT user_id, item_id, category_id FROM history")
def _(s):
    return s.history


@query(
    "train_pair_events",
    """
SELECT e.timestamp, e.user_id, e.item_id, e.event, e.transaction_id FROM clean_events e
WHERE EXISTS (SELECT 1 FROM train t WHERE t.user_id = e.user_id AND t.item_id = e.item_id)""",
)
def _(s):
    return f.events_of_pairs(s.stored_events, s.train)


@query(
    "split_data_stats",
    """
SELECT a.*, b.*,
  (SELECT count(DISTINCT user_id) FROM test WHERE user_id IN (SELECT user_id FROM train)) AS warm_users_in_test,
  train_users AS n_users_in_model, train_items AS n_items_in_model
FROM (SELECT count(DISTINCT user_id) AS train_users, count(DISTINCT item_id) AS train_items,
             count(*) AS train_interactions FROM train) a,
     (SELECT count(DISTINCT user_id) AS test_users, count(DISTINCT item_id) AS test_items,
             count(*) AS test_interactions FROM test) b""",
)
def _(s):
    return f.split_stats(s.train, s.test)


@query(
    "artifact_counts",
    """
SELECT count(DISTINCT item_id) AS items_with_category, count(DISTINCT category_id) AS n_categories,
       (SELECT count(DISTINCT item_id) FROM item_available) AS items_with_availability FROM item_categories""",
)
def _(s):
    return f.artifact_counts(s.categories, f.item_availability(s.properties))
