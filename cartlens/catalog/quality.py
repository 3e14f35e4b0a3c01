"""Offline metrics on the deterministic lists."""

from pyspark.sql import functions as F

from cartlens.catalog.registry import query
from cartlens.operators import features, metrics, popular
from cartlens.session import stage


def hits_sql(test: str, recs: str = "recs") -> str:
    """Per user: list rows with relevance, and the number of test items."""
    return f"""
rel AS (SELECT DISTINCT user_id, item_id FROM {test}),
per_user AS (SELECT user_id, count(*) AS relevant FROM rel GROUP BY 1),
judged AS (SELECT r.user_id, r.item_id, r.rank, CASE WHEN x.item_id IS NULL THEN 0 ELSE 1 END AS hit
           FROM {recs} r LEFT JOIN rel x ON x.user_id = r.user_id AND x.item_id = r.item_id)"""


def quality_sql(k: int) -> str:
    return f"""
(SELECT avg(hits / {k}.0::DOUBLE) AS precision, avg(hits / relevant::DOUBLE) AS recall,
        least(1.0, greatest(0.0, avg(gain / ideal))) AS ndcg
 FROM (SELECT j.user_id, sum(hit) AS hits, sum(hit / log2(rank + 1)) AS gain FROM judged j WHERE rank <= {k} GROUP BY 1)
 JOIN per_user USING (user_id)
 JOIN (SELECT n, sum(1.0::DOUBLE / log2(n2 + 1)) AS ideal FROM range(1, {k} + 1) a(n), range(1, {k} + 1) b(n2) WHERE n2 <= n GROUP BY 1) d
   ON d.n = least(relevant, {k}))"""


def hit_rate_sql(k: int) -> str:
    return f"(SELECT count(DISTINCT user_id) FROM judged WHERE hit = 1 AND rank <= {k}) / (SELECT count(*) FROM per_user)::DOUBLE"


def coverage_sql(k: int, recs: str = "recs") -> str:
    return f"least(1.0, (SELECT count(DISTINCT item_id) FROM {recs} WHERE rank <= {k}) / (SELECT count(DISTINCT item_id) FROM train)::DOUBLE)"


def novelty_sql(k: int, recs: str = "recs") -> str:
    return f"""
(SELECT avg(-log2(coalesce(c.n, 1) / (SELECT count(*) FROM train)::DOUBLE)) FROM {recs} r
 LEFT JOIN (SELECT item_id, count(*) AS n FROM train GROUP BY 1) c USING (item_id) WHERE r.rank <= {k})"""


def diversity_metric_sql(k: int, recs: str = "recs") -> str:
    return f"""
(SELECT avg(n) FROM (SELECT user_id, count(DISTINCT category_id) AS n FROM {recs} JOIN item_categories USING (item_id)
 WHERE rank <= {k} AND category_id IS NOT NULL GROUP BY 1))"""


def cart_sql(k: int, recs: str = "recs") -> str:
    return f"""
((SELECT count(DISTINCT r.user_id) FROM {recs} r JOIN test_events e ON e.user_id = r.user_id AND e.item_id = r.item_id
  WHERE e.event = 'addtocart' AND r.rank <= {k}) / (SELECT count(DISTINCT user_id) FROM {recs} WHERE rank <= {k})::DOUBLE)"""


def _catalogue(s):
    return s.item_totals.agg(F.count("item_id").alias("n"))


def _quality(k: int) -> str:
    return f"""
WITH {hits_sql("test")}
SELECT round(precision, 6) AS "precision@k", round(recall, 6) AS "recall@k", round(ndcg, 6) AS "ndcg@k" FROM {quality_sql(k)}"""


@query("precision_recall_ndcg_at_5", _quality(5))
def _(s):
    return metrics.precision_recall_ndcg_at_k(s.test, s.recs, 5)


@query("precision_recall_ndcg_at_20", _quality(20))
def _(s):
    return metrics.precision_recall_ndcg_at_k(s.test, s.recs, 20)


@query("hit_rate_at_5", f'WITH {hits_sql("targets")} SELECT round({hit_rate_sql(5)}, 6) AS "hit_rate@k"')
def _(s):
    return metrics.hit_rate_at_k(s.targets, s.recs, 5)


@query("coverage_at_5", f'SELECT round({coverage_sql(5)}, 6) AS "coverage@k"')
def _(s):
    return metrics.coverage_at_k(s.recs, _catalogue(s), 5)


@query("novelty_at_5", f'SELECT round({novelty_sql(5)}, 6) AS "novelty@k"')
def _(s):
    return metrics.novelty_at_k(s.recs, s.train, 5)


@query("diversity_at_5", f'SELECT round({diversity_metric_sql(5)}, 6) AS "diversity@k"')
def _(s):
    return metrics.diversity_at_k(s.recs, s.categories, 5)


@query("cart_prediction_rate_at_5", f'SELECT round({cart_sql(5)}, 6) AS "cart_prediction_rate@k"')
def _(s):
    return metrics.cart_prediction_rate(s.test_events, s.recs, 5)


def all_metrics_sql(recs: str = "recs") -> str:
    q = {k: quality_sql(k) for k in (5, 10, 20, 50)}
    rows = [
        ("recall@20", f"(SELECT recall FROM {q[20]})"),
        ("precision@5", f"(SELECT precision FROM {q[5]})"),
        ("ndcg@10", f"(SELECT ndcg FROM {q[10]})"),
        ("hit_rate@5", hit_rate_sql(5)),
        ("recall@50", f"(SELECT recall FROM {q[50]})"),
        ("precision@k", f"(SELECT precision FROM {q[5]})"),
        ("recall@k", f"(SELECT recall FROM {q[5]})"),
        ("ndcg@k", f"(SELECT ndcg FROM {q[5]})"),
        ("hit_rate@k", hit_rate_sql(5)),
        ("precision@10", f"(SELECT precision FROM {q[10]})"),
        ("recall@10", f"(SELECT recall FROM {q[10]})"),
        ("hit_rate@10", hit_rate_sql(10)),
        ("coverage@k", coverage_sql(5, recs)),
        ("novelty@k", novelty_sql(5, recs)),
        ("cart_prediction_rate@5", cart_sql(5, recs)),
        ("diversity@k", diversity_metric_sql(5, recs)),
    ]
    body = "\nUNION ALL\n".join(f"SELECT '{name}' AS metric, round({expr}, 6) AS value" for name, expr in rows)
    return f"{hits_sql('targets', recs)}\n{body}"


def _all(s, recs):
    recs = stage(recs, "lists")  # read by five metrics
    return metrics.compute_all_metrics(
        s.test, recs, s.train, _catalogue(s), 5, s.categories, s.targets, s.test_events, s.item_totals
    )


@query("all_metrics", f"WITH {all_metrics_sql()}")
def _(s):
    return _all(s, s.recs)


@query("metrics_tracking_names", f"SELECT replace(metric, '@', '_') AS metric, value FROM (WITH {all_metrics_sql()})")
def _(s):
    return metrics.tracking_names(_all(s, s.recs))


_BASELINE_RECS = """
baseline_recs AS (
  SELECT u.user_id, p.item_id, p.rank FROM test_users u CROSS JOIN (
    SELECT item_id, row_number() OVER (ORDER BY score DESC, item_id) AS rank
    FROM (SELECT item_id, sum(CASE event WHEN 'addtocart' THEN 10.0::DOUBLE ELSE 8.0 END) AS score
          FROM clean_events e WHERE event IN ('addtocart', 'transaction')
            AND EXISTS (SELECT 1 FROM train t WHERE t.user_id = e.user_id AND t.item_id = e.item_id)
          GROUP BY 1 ORDER BY score DESC, item_id LIMIT 100)) p WHERE p.rank <= 20)"""


def _baseline(s):
    best = popular.top_popular_items_by_cart(features.events_of_pairs(s.stored_events, s.train), 100)
    return popular.popular_for_users(s.test, best, 20)


@query("baseline_metrics", f"WITH {_BASELINE_RECS}, {all_metrics_sql('baseline_recs')}")
def _(s):
    return _all(s, _baseline(s))


_TWO_MODELS = f"""
WITH m AS (WITH {all_metrics_sql()}), b AS (WITH {_BASELINE_RECS}, {all_metrics_sql('baseline_recs')})"""


@query(
    "experiment_comparison",
    f"""{_TWO_MODELS}
SELECT metric, m.value AS model, b.value AS baseline,
       round(CASE WHEN b.value <> 0 THEN (m.value / b.value - 1.0) * 100.0 END, 6) AS change_pct
FROM m JOIN b USING (metric)""",
)
def _(s):
    rounded = F.round("value", 6).alias("value")
    model, base = _all(s, s.recs).select("metric", rounded), _all(s, _baseline(s)).select("metric", rounded)
    return metrics.compare_experiments(model, base)


@query(
    "metric_degradation",
    f"""{_TWO_MODELS}
SELECT metric, m.value AS current, b.value AS previous, round((m.value - b.value) / b.value, 6) AS change,
       round((m.value - b.value) / b.value * 100.0, 6) AS change_pct
FROM m JOIN b USING (metric)
WHERE metric IN ('precision@5', 'precision@10', 'recall@10', 'recall@20', 'ndcg@10', 'hit_rate@5', 'hit_rate@10')
  AND b.value > 0 AND (m.value - b.value) / b.value < -0.1::DOUBLE""",
)
def _(s):
    rounded = F.round("value", 6).alias("value")
    model, base = _all(s, s.recs).select("metric", rounded), _all(s, _baseline(s)).select("metric", rounded)
    return metrics.check_degradation(model, base)


@query(
    "degradation_gate_status",
    f"""{_TWO_MODELS}
SELECT degraded_metrics, target_pairs, degraded_metrics > 0 AND target_pairs >= 100 AS blocked
FROM (SELECT count(*) AS degraded_metrics, (SELECT count(*) FROM targets) AS target_pairs
      FROM m JOIN b USING (metric)
      WHERE metric IN ('precision@5', 'precision@10', 'recall@10', 'recall@20', 'ndcg@10', 'hit_rate@5', 'hit_rate@10')
        AND b.value > 0 AND (m.value - b.value) / b.value < -0.1::DOUBLE)""",
)
def _(s):
    rounded = F.round("value", 6).alias("value")
    model, base = _all(s, s.recs).select("metric", rounded), _all(s, _baseline(s)).select("metric", rounded)
    return metrics.gate_status(metrics.check_degradation(model, base), s.targets)
