"""Batch answers to requests, from validation to impressions."""

from pyspark.sql import functions as F

from cartlens.catalog.registry import query
from cartlens.operators import abtest, serving


@query(
    "request_status",
    """
SELECT request_id, CAST(CASE WHEN top_k NOT BETWEEN 1 AND 500 THEN 400 WHEN user_id < 0 THEN 404 ELSE 200 END AS INTEGER) AS status
FROM requests""",
)
def _(s):
    return serving.request_status(s.requests).select("request_id", "status")


@query("ab_assignment", "SELECT request_id, arm, ab_test_group FROM routed")
def _(s):
    return serving.assign_group(s.requests).select("request_id", "arm", "ab_test_group")


@query("request_routes", "SELECT request_id, user_id, status, model_type, ab_test_group FROM routed")
def _(s):
    return serving.route_requests(s.requests, s.train.select("user_id")).select(
        "request_id", "user_id", "status", "model_type", "ab_test_group"
    )


@query(
    "popular_answers",
    """
SELECT r.request_id, p.item_id, 0.0::DOUBLE AS score, p.pop_rank AS rank, r.model_type
FROM routed r JOIN popular p ON p.pop_rank <= r.top_k WHERE r.model_type IN ('baseline', 'fallback')""",
)
def _(s):
    return _flat(s.served.filter(F.col("model_type").isin("baseline", "fallback")))


def _flat(served):
    return served.select("request_id", "model_type", F.posexplode("recommendations").alias("_p", "_r")).select(
        "request_id",
        F.col("_r.item_id").alias("item_id"),
        F.col("_r.score").alias("score"),
        (F.col("_p") + 1).alias("rank"),
        "model_type",
    )


@query(
    "personal_lists",
    "SELECT user_id, top_k, reranked, item_id, round(score, 6) AS score, rank FROM serving_lists",
)
def _(s):
    return s.serving_lists


_SERVED = """
SELECT r.request_id, p.item_id, 0.0::DOUBLE AS score, p.pop_rank AS rank, r.model_type, r.top_k
FROM routed r JOIN popular p ON p.pop_rank <= r.top_k WHERE r.model_type IN ('baseline', 'fallback')
UNION ALL
SELECT r.request_id, l.item_id, l.score, l.rank, r.model_type, r.top_k
FROM routed r JOIN serving_lists l ON l.user_id = r.user_id AND l.top_k = r.top_k AND l.reranked = (r.model_type = 'rerank')
WHERE r.model_type IN ('als', 'rerank')"""


@query("served_recommendations", f"SELECT request_id, item_id, round(score, 6) AS score, rank, model_type FROM ({_SERVED})")
def _(s):
    return _flat(s.served)


@query(
    "served_requests",
    f"""
SELECT r.request_id, r.status, r.model_type, r.ab_test_group, r.model_type IN ('baseline', 'fallback') AS cold,
       CAST(coalesce(n, 0) AS INTEGER) AS n_recs
FROM routed r LEFT JOIN (SELECT request_id, count(*) AS n FROM ({_SERVED}) GROUP BY 1) s USING (request_id)""",
)
def _(s):
    return s.served.select(
        "request_id", "status", "model_type", "ab_test_group", "cold", F.coalesce(F.size("recommendations"), F.lit(0)).alias("n_recs")
    )


_IMPRESSIONS = f"""
SELECT model_type, CAST(sum(n) AS BIGINT) AS impressions FROM (
  SELECT model_type, top_k AS n FROM routed WHERE model_type IN ('baseline', 'fallback')
  UNION ALL SELECT model_type, 1 FROM ({_SERVED}) WHERE model_type IN ('als', 'rerank')) GROUP BY 1"""


@query("impressions_by_model", _IMPRESSIONS)
def _(s):
    return serving.impressions(s.served)


@query(
    "usage_statistics",
    """
SELECT count(*) AS total_requests, count(*) FILTER (model_type = 'als') AS personal_recommendations,
       count(*) FILTER (model_type = 'fallback') AS popular_fallback, count(*) FILTER (model_type = 'rerank') AS rerank_applied,
       count(*) FILTER (model_type = 'baseline') AS baseline_recommendations,
       count(*) FILTER (model_type IN ('als', 'rerank')) AS als_requests
FROM routed WHERE status = 200""",
)
def _(s):
    return abtest.usage_stats(s.routed)


@query(
    "usage_business_metrics",
    f"""
SELECT impressions, clicks, addtocart, transactions, round(revenue, 6) AS revenue,
       round(clicks / impressions::DOUBLE, 6) AS ctr, round(transactions / impressions::DOUBLE, 6) AS conversion_rate
FROM (SELECT count(*) FILTER (event = 'click') AS clicks, count(*) FILTER (event = 'addtocart') AS addtocart,
             count(*) FILTER (event = 'transaction') AS transactions,
             sum(revenue) FILTER (event = 'transaction') AS revenue FROM rec_log) e,
     (SELECT CAST(sum(impressions) AS BIGINT) AS impressions FROM ({_IMPRESSIONS})) i""",
)
def _(s):
    return abtest.usage_business_metrics(s.served, s.log.withColumnRenamed("event", "event_type"), serving.impressions(s.served))
