"""Popularity lists and popularity-based recommendations."""

from cartlens.catalog.registry import query
from cartlens.config import PRODUCTION
from cartlens.operators import features, popular, recommend

_K = PRODUCTION.evaluation.popular_k


@query("top_popular_items", "SELECT item_id, round(score, 6) AS score, pop_rank FROM popular")
def _(s):
    return s.popular


_BY_CART = """
SELECT item_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, item_id) AS INTEGER) AS pop_rank
FROM (SELECT item_id, sum(CASE event WHEN 'addtocart' THEN 10.0::DOUBLE ELSE 8.0 END) AS score
      FROM clean_events e WHERE event IN ('addtocart', 'transaction')
        AND EXISTS (SELECT 1 FROM train t WHERE t.user_id = e.user_id AND t.item_id = e.item_id)
      GROUP BY 1 ORDER BY score DESC, item_id LIMIT 100)"""


def _by_cart(s):
    return popular.top_popular_items_by_cart(features.events_of_pairs(s.stored_events, s.train), _K)


@query("top_popular_items_by_cart", _BY_CART)
def _(s):
    return _by_cart(s)


@query(
    "popular_items_by_category",
    """
SELECT category_id, CAST(pos AS INTEGER) AS pos, item_id FROM (
  SELECT category_id, item_id, row_number() OVER (PARTITION BY category_id ORDER BY total DESC, item_id) AS pos
  FROM (SELECT item_id, sum(rating) AS total FROM train GROUP BY 1) JOIN item_categories USING (item_id)
  WHERE category_id IS NOT NULL) WHERE pos <= 10""",
)
def _(s):
    return popular.popular_by_category(s.train, s.categories)


@query(
    "baseline_recommendations",
    f"""
SELECT u.user_id, p.item_id, p.pop_rank AS rank FROM test_users u CROSS JOIN ({_BY_CART}) p WHERE p.pop_rank <= 20""",
)
def _(s):
    return popular.popular_for_users(s.test, _by_cart(s), 20)


@query("popular_unseen_recommendations", "SELECT user_id, item_id, rank FROM recs")
def _(s):
    return s.recs


# Warm and cold come from the strict interactions: users without enough pairs are cold.
_STRICT_USERS = """
(SELECT DISTINCT user_id FROM (
  SELECT *, count(*) OVER (PARTITION BY user_id) AS u, count(*) OVER (PARTITION BY item_id) AS i FROM all_pairs)
 WHERE u >= 40 AND i >= 5)"""


def _strict_users(s):
    from cartlens.config import InteractionConfig

    return s.interactions(InteractionConfig(min_user_interactions=40, min_item_interactions=5)).select("user_id")


@query(
    "warm_and_cold_users",
    f"""
SELECT user_id, CASE WHEN user_id IN {_STRICT_USERS} THEN 'warm' ELSE 'cold' END AS side FROM test_users""",
)
def _(s):
    from pyspark.sql import functions as F

    warm, cold = recommend.warm_cold_users(s.test, _strict_users(s))
    return warm.withColumn("side", F.lit("warm")).unionByName(cold.withColumn("side", F.lit("cold")))


@query(
    "cold_fallback_plain",
    f"""
SELECT u.user_id, p.item_id, p.pop_rank AS rank
FROM (SELECT user_id FROM test_users WHERE user_id NOT IN {_STRICT_USERS}) u CROSS JOIN popular p WHERE p.pop_rank <= 20""",
)
def _(s):
    _, cold = recommend.warm_cold_users(s.test, _strict_users(s))
    return recommend.cold_recommendations(cold, s.popular, 20)


@query(
    "cold_fallback_by_category",
    f"""
WITH cold AS (SELECT user_id FROM test_users WHERE user_id NOT IN {_STRICT_USERS}),
cats AS (SELECT DISTINCT e.user_id, c.category_id FROM clean_events e JOIN item_categories c USING (item_id)
         WHERE c.category_id IS NOT NULL AND e.event <> 'view'),
ranked AS (
  SELECT cold.user_id, p.item_id, row_number() OVER (
           PARTITION BY cold.user_id ORDER BY (p.pop_rank <= 20 AND k.category_id IS NOT NULL) DESC, p.pop_rank) AS r
  FROM cold CROSS JOIN popular p LEFT JOIN item_categories c ON c.item_id = p.item_id
  LEFT JOIN cats k ON k.user_id = cold.user_id AND k.category_id = c.category_id)
SELECT user_id, item_id, CAST(r AS INTEGER) AS rank FROM ranked WHERE r <= 20""",
)
def _(s):
    from pyspark.sql import functions as F

    _, cold = recommend.warm_cold_users(s.test, _strict_users(s))
    recent = s.stored_events.filter(F.col("event") != "view")
    return recommend.cold_recommendations(cold, s.popular, 20, s.categories, recent)
