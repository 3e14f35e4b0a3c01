"""Category re-ranking and the diversity constraint."""

from cartlens.catalog.registry import query
from cartlens.operators import diversity, features, popular, rerank

_TOP_CATEGORIES = """
SELECT user_id, category_id, n, CAST(r AS INTEGER) AS pos FROM (
  SELECT user_id, category_id, count(*) AS n,
         row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, category_id) AS r
  FROM history GROUP BY 1, 2) WHERE r <= 3"""
_NEIGHBOURS = """
SELECT category_id, parent_id AS neighbour_id FROM clean_tree WHERE parent_id IS NOT NULL
UNION SELECT parent_id, category_id FROM clean_tree WHERE parent_id IS NOT NULL"""


@query("user_top_categories", _TOP_CATEGORIES)
def _(s):
    return rerank.top_user_categories(s.history)


@query("category_neighbours", _NEIGHBOURS)
def _(s):
    return rerank.tree_neighbours(s.tree)


def _weights(alpha: float, beta: float) -> str:
    return f"""
CASE WHEN coalesce(n, 0) < 5 THEN 0.3::DOUBLE WHEN coalesce(n, 0) < 20 THEN 0.5::DOUBLE ELSE {alpha}::DOUBLE END AS w_rank,
CASE WHEN coalesce(n, 0) < 5 THEN 0.7::DOUBLE WHEN coalesce(n, 0) < 20 THEN 0.5::DOUBLE ELSE {beta}::DOUBLE END AS w_category"""


@query(
    "adaptive_weights",
    f"""
SELECT user_id, coalesce(n, 0) AS history_len, {_weights(0.7, 0.3)}
FROM test_users LEFT JOIN (SELECT user_id, count(*) AS n FROM history GROUP BY 1) USING (user_id)""",
)
def _(s):
    return rerank.adaptive_weights(s.history, s.test, 0.7, 0.3)


@query(
    "normalised_category_popularity",
    """
SELECT category_id, round(n_events / (SELECT CASE WHEN max(n_events) = 0 THEN 1.0::DOUBLE ELSE max(n_events)::DOUBLE END FROM cat_stats), 6) AS popularity
FROM cat_stats""",
)
def _(s):
    return rerank.normalised_popularity(s.category_stats)


def rerank_sql(
    top_k: int, alpha: float, beta: float, adaptive: bool = True, tree: bool = True, mixed: bool = False
) -> str:
    near = "EXISTS (SELECT 1 FROM top3 JOIN near ON near.neighbour_id = top3.category_id WHERE top3.user_id = r.user_id AND near.category_id = c.category_id)"
    weights = _weights(alpha, beta) if adaptive else f"{alpha}::DOUBLE AS w_rank, {beta}::DOUBLE AS w_category"
    sql = f"""
WITH top3 AS ({_TOP_CATEGORIES}), near AS ({_NEIGHBOURS}),
pop AS (SELECT category_id, n_events / (SELECT max(n_events)::DOUBLE FROM cat_stats) AS popularity FROM cat_stats),
scored AS (
  SELECT r.user_id, r.item_id, r.rank, {weights},
         CASE WHEN r.rank > 0 THEN 1.0::DOUBLE / r.rank ELSE 0 END AS rank_score,
         CASE WHEN c.category_id IS NULL THEN 0.0::DOUBLE
              WHEN EXISTS (SELECT 1 FROM top3 WHERE top3.user_id = r.user_id AND top3.category_id = c.category_id) THEN 1.0::DOUBLE
              WHEN {near if tree else "false"} THEN 0.5::DOUBLE
              ELSE 0.2::DOUBLE * coalesce(p.popularity, 0.0::DOUBLE) END AS category_score
  FROM recs r LEFT JOIN item_categories c ON c.item_id = r.item_id LEFT JOIN pop p ON p.category_id = c.category_id
  LEFT JOIN (SELECT user_id, count(*) AS n FROM history GROUP BY 1) h ON h.user_id = r.user_id)
SELECT user_id, item_id, CAST(new AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id
            ORDER BY w_rank * rank_score + w_category * category_score DESC, rank, item_id) AS new FROM scored)
WHERE new <= {top_k}"""
    if mixed:
        for name in ("item_categories", "history", "cat_stats"):
            sql = sql.replace(name, f"mixed_{name}")
    return sql


@query("category_rerank", rerank_sql(5, 0.7, 0.3))
def _(s):
    return rerank.category_rerank(s.recs, s.history, s.categories, s.category_stats, s.tree)


@query("category_rerank_production", rerank_sql(20, 0.6, 0.4))
def _(s):
    return rerank.category_rerank(
        s.recs, s.history, s.categories, s.category_stats, s.tree, top_k=20, alpha=0.6, beta=0.4
    )


@query("category_rerank_fixed_weights", rerank_sql(5, 0.7, 0.3, adaptive=False))
def _(s):
    return rerank.category_rerank(s.recs, s.history, s.categories, s.category_stats, s.tree, adaptive=False)


@query("category_rerank_without_tree", rerank_sql(5, 0.2, 0.8, adaptive=False, tree=False))
def _(s):
    return rerank.category_rerank(
        s.recs, s.history, s.categories, s.category_stats, alpha=0.2, beta=0.8, adaptive=False
    )


@query("category_rerank_mixed_levels", rerank_sql(10, 0.7, 0.3, mixed=True))
def _(s):
    """A third of the items sit in middle categories, so list items and liked categories can be tree neighbours."""
    mixed = s.mixed_categories
    stats = features.category_stats(s.stored_events, mixed)
    history = features.user_history(s.train, mixed)
    return rerank.category_rerank(s.recs, history, mixed, stats, s.tree, top_k=10)


def diversity_sql(cap: int, fill: bool) -> str:
    fills = f"""
UNION ALL
SELECT user_id, item_id, kept + j AS rank, 1 AS is_fill FROM (
  SELECT s.user_id, p.item_id, s.kept, s.needed, row_number() OVER (PARTITION BY s.user_id ORDER BY p.category_id, p.pos) AS j
  FROM sizes s CROSS JOIN pool p
  WHERE NOT EXISTS (SELECT 1 FROM kept_rows k WHERE k.user_id = s.user_id AND (k.category_id = p.category_id OR k.item_id = p.item_id)))
WHERE j <= needed"""
    return f"""
WITH marked AS (
  SELECT r.*, c.category_id, c.category_id IS NULL OR
         row_number() OVER (PARTITION BY r.user_id, c.category_id ORDER BY r.rank) <= {cap} AS keep
  FROM recs r LEFT JOIN item_categories c USING (item_id)),
kept_rows AS (SELECT * FROM marked WHERE keep),
sizes AS (SELECT user_id, count(*) FILTER (keep) AS kept, count(*) FILTER (NOT keep) AS needed FROM marked GROUP BY 1),
pool AS (
  SELECT category_id, pos, item_id FROM (
    SELECT category_id, item_id, row_number() OVER (PARTITION BY category_id ORDER BY total DESC, item_id) AS pos
    FROM (SELECT item_id, sum(rating) AS total FROM train GROUP BY 1) JOIN item_categories USING (item_id)
    WHERE category_id IS NOT NULL) WHERE pos <= 10),
merged AS (SELECT user_id, item_id, rank, 0 AS is_fill FROM kept_rows {fills if fill else ""})
SELECT user_id, item_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY rank, is_fill) AS INTEGER) AS rank FROM merged"""


@query("diversity_constraint", diversity_sql(2, True))
def _(s):
    pool = popular.popular_by_category(s.train, s.categories)
    return diversity.apply_diversity_constraint(s.recs, s.categories, 2, pool, list_size=20)


@query("diversity_constraint_one_per_category", diversity_sql(1, True))
def _(s):
    pool = popular.popular_by_category(s.train, s.categories)
    return diversity.apply_diversity_constraint(s.recs, s.categories, 1, pool, list_size=20)


@query("diversity_cap_without_refill", diversity_sql(1, False))
def _(s):
    return diversity.apply_diversity_constraint(s.recs, s.categories, 1)
