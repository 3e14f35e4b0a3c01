"""SQL twins of the shop views, in dependency order. They stand on their own and share no code with the operators."""

from __future__ import annotations

VIEWS: dict[str, str] = {}
RECURSIVE_VIEWS = {"tree_walk"}

VIEWS["rec_events"] = """
  SELECT timestamp, user_id, item_id, event, transaction_id
  FROM (
    SELECT epoch_ms(l_shipdate) + 456624000000 + ((l_orderkey * 7 + l_linenumber) % 86400) * 1000 AS timestamp,
           CASE WHEN l_orderkey % 101 <> 0 THEN o_custkey END AS user_id,
           l_partkey AS item_id,
           CASE WHEN l_quantity <= 40 THEN 'view' WHEN l_quantity <= 46 THEN 'addtocart'
                WHEN l_quantity <= 49 THEN 'transaction' ELSE 'refund' END AS event,
           CASE WHEN l_quantity > 46 AND l_quantity <= 49 THEN CAST(l_orderkey AS VARCHAR) END AS transaction_id,
           CASE WHEN l_orderkey % 97 = 0 THEN 2 ELSE 1 END AS copies
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  ) base JOIN (SELECT unnest([1, 2]) AS copy) c ON c.copy <= base.copies
"""
VIEWS["clean_events"] = """
  SELECT DISTINCT * FROM rec_events
  WHERE user_id IS NOT NULL AND item_id IS NOT NULL AND timestamp IS NOT NULL AND event IS NOT NULL
    AND event IN ('view', 'addtocart', 'transaction')
    AND timestamp BETWEEN 1262304000000 AND 1893456000000
    AND user_id > 0 AND item_id > 0
"""
VIEWS["rec_properties"] = """
  SELECT 1262304000000 + p_partkey * 1000 AS timestamp, p_partkey AS item_id, 'categoryid' AS property,
         CAST(100 + p_partkey % 25 AS VARCHAR) AS value FROM part
  UNION ALL
  SELECT 1420070400000 + p_partkey * 1000, p_partkey, 'categoryid',
         CAST(100 + CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) AS VARCHAR) FROM part WHERE p_partkey % 5 <> 0
  UNION ALL
  SELECT 1420070400000 + p_partkey * 1000, p_partkey, 'available', CAST(p_size % 2 AS VARCHAR) FROM part
"""
VIEWS["clean_properties"] = """
  SELECT DISTINCT * FROM rec_properties
  WHERE item_id IS NOT NULL AND property IS NOT NULL AND timestamp IS NOT NULL
    AND timestamp BETWEEN 1262304000000 AND 1893456000000 AND item_id > 0
"""
VIEWS["rec_tree"] = """
  SELECT 100 + b AS category_id, CASE WHEN b % 6 = 0 THEN 999 ELSE 10 + b % 6 END AS parent_id
  FROM (SELECT DISTINCT CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT) AS b FROM part)
  UNION ALL
  SELECT * FROM (VALUES (10::BIGINT, 1::BIGINT), (11, 2), (12, 1), (13, 2), (14, 1), (15, 2),
                        (1, NULL), (2, NULL), (50, 51), (51, 50)) v(category_id, parent_id)
"""
VIEWS["clean_tree"] = """
  SELECT DISTINCT * FROM rec_tree
  WHERE category_id IS NOT NULL AND category_id > 0 AND (parent_id IS NULL OR parent_id > 0)
"""
VIEWS["tree_walk"] = """
  SELECT category_id, 1 AS level FROM clean_tree WHERE parent_id IS NULL
  UNION ALL
  SELECT t.category_id, w.level + 1 FROM tree_walk w JOIN clean_tree t ON t.parent_id = w.category_id
  WHERE w.level <= 20
"""
VIEWS["tree_levels"] = """
  SELECT t.category_id, t.parent_id, CAST(l.level AS INTEGER) AS level
  FROM clean_tree t LEFT JOIN (SELECT category_id, min(level) AS level FROM tree_walk GROUP BY 1) l
  ON l.category_id = t.category_id
"""
VIEWS["item_categories"] = """
  SELECT item_id, category_id FROM (
    SELECT item_id, CAST(value AS BIGINT) AS category_id,
           row_number() OVER (PARTITION BY item_id ORDER BY timestamp DESC, CAST(value AS BIGINT) DESC) AS r
    FROM clean_properties WHERE property = 'categoryid') WHERE r = 1
"""
VIEWS["item_available"] = """
  SELECT item_id, value AS available_value FROM (
    SELECT item_id, value, row_number() OVER (PARTITION BY item_id ORDER BY timestamp DESC, value DESC NULLS LAST) AS r
    FROM clean_properties WHERE property = 'available') WHERE r = 1
"""
VIEWS["cat_stats"] = """
  SELECT category_id, count(*) AS n_events, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items
  FROM clean_events JOIN item_categories USING (item_id) WHERE category_id IS NOT NULL GROUP BY category_id
"""
VIEWS["weighted_events"] = """
  SELECT *, CASE event WHEN 'view' THEN 1.0::DOUBLE WHEN 'addtocart' THEN 4.0 WHEN 'transaction' THEN 8.0 ELSE 1.0 END AS event_weight
  FROM clean_events
"""
VIEWS["item_pop"] = """
  SELECT item_id, count(*) AS n_events, count(DISTINCT user_id) AS n_users, sum(event_weight) AS weighted_score
  FROM weighted_events GROUP BY item_id
"""
VIEWS["all_pairs"] = """
  SELECT user_id, item_id, sum(event_weight) AS rating, max(timestamp) AS timestamp FROM weighted_events GROUP BY 1, 2
"""
VIEWS["interactions"] = """
  SELECT user_id, item_id, rating, timestamp FROM (
    SELECT *, count(*) OVER (PARTITION BY user_id) AS u, count(*) OVER (PARTITION BY item_id) AS i FROM all_pairs)
  WHERE u >= 5 AND i >= 5
"""
VIEWS["placed"] = """
  SELECT *, count(*) OVER (PARTITION BY user_id) AS n,
         row_number() OVER (PARTITION BY user_id ORDER BY timestamp, item_id) AS r
  FROM interactions
"""
VIEWS["train"] = """
  SELECT user_id, item_id, rating, timestamp FROM placed
  WHERE r <= greatest(1.0::DOUBLE, floor(n * (1.0::DOUBLE - 0.15::DOUBLE)))
"""
VIEWS["test"] = """
  SELECT user_id, item_id, rating, timestamp FROM placed
  WHERE r > greatest(1.0::DOUBLE, floor(n * (1.0::DOUBLE - 0.15::DOUBLE)))
"""
VIEWS["test_events"] = """
  SELECT timestamp, user_id, item_id, event, transaction_id FROM (
    SELECT *, count(*) OVER (PARTITION BY user_id) AS n,
           row_number() OVER (PARTITION BY user_id ORDER BY timestamp, item_id, event, transaction_id NULLS FIRST) AS r
    FROM clean_events)
  WHERE r > greatest(1.0::DOUBLE, floor(n * (1.0::DOUBLE - 0.15::DOUBLE)))
"""
VIEWS["purchased"] = "SELECT DISTINCT user_id, item_id FROM clean_events WHERE event = 'transaction'"
VIEWS["targets"] = """
  SELECT t.* FROM test t WHERE EXISTS (
    SELECT 1 FROM test_events e WHERE e.user_id = t.user_id AND e.item_id = t.item_id
      AND e.event IN ('addtocart', 'transaction'))
"""
VIEWS["history"] = """
  SELECT t.user_id, t.item_id, c.category_id FROM train t JOIN item_categories c USING (item_id)
  WHERE c.category_id IS NOT NULL
"""
VIEWS["mixed_item_categories"] = """
  SELECT item_id, CASE WHEN item_id % 3 = 0 AND (category_id - 100) % 6 <> 0 THEN 10 + (category_id - 100) % 6
                       WHEN item_id % 17 = 0 THEN NULL ELSE category_id END AS category_id
  FROM item_categories
"""
VIEWS["mixed_history"] = """
  SELECT t.user_id, t.item_id, c.category_id FROM train t JOIN mixed_item_categories c USING (item_id)
  WHERE c.category_id IS NOT NULL
"""
VIEWS["mixed_cat_stats"] = """
  SELECT category_id, count(*) AS n_events FROM clean_events JOIN mixed_item_categories USING (item_id)
  WHERE category_id IS NOT NULL GROUP BY category_id
"""
VIEWS["popular"] = """
  SELECT item_id, score, CAST(row_number() OVER (ORDER BY score DESC, item_id) AS INTEGER) AS pop_rank
  FROM (SELECT item_id, sum(rating) AS score FROM train GROUP BY 1 ORDER BY score DESC, item_id LIMIT 100)
"""
VIEWS["test_users"] = "SELECT DISTINCT user_id FROM test"
VIEWS["recs"] = """
  SELECT user_id, item_id, CAST(r AS INTEGER) AS rank FROM (
    SELECT u.user_id, p.item_id, row_number() OVER (PARTITION BY u.user_id ORDER BY p.pop_rank) AS r
    FROM test_users u CROSS JOIN popular p
    WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = u.user_id AND t.item_id = p.item_id))
  WHERE r <= 20
"""
VIEWS["full_history"] = """
  SELECT t.user_id, t.item_id, c.category_id FROM train t LEFT JOIN item_categories c USING (item_id)
"""
VIEWS["rec_log"] = """
  SELECT ts, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
         CASE event_type WHEN 'view' THEN 'impression' WHEN 'signup' THEN 'addtocart'
              WHEN 'purchase' THEN 'transaction' ELSE event_type END AS event,
         CASE WHEN event_type = 'purchase' THEN value ELSE 0.0::DOUBLE END AS revenue,
         CASE user_id % 4 WHEN 0 THEN 'als' WHEN 1 THEN 'rerank' WHEN 2 THEN 'baseline' ELSE 'fallback' END AS model_type,
         CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
         CASE WHEN event_type IN ('view', 'error') THEN '/recommendations' ELSE '/events' END AS endpoint,
         value / 100.0::DOUBLE AS latency_s,
         event_type = 'view' AND user_id % 4 >= 2 AS cold,
         CASE WHEN event_type = 'view' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS n_recs
  FROM events
"""
VIEWS["requests"] = """
  SELECT event_id AS request_id,
         CASE WHEN event_id % 11 = 0 THEN -user_id - 1 ELSE user_id END AS user_id,
         CAST(CASE WHEN event_id % 7 = 0 THEN 0 WHEN event_id % 5 = 0 THEN 20 ELSE 10 END AS INTEGER) AS top_k,
         CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS use_rerank,
         event_id % 13 = 0 AS use_baseline,
         CASE event_id % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'als' WHEN 2 THEN 'baseline' END AS ab_test_group
  FROM events WHERE event_type = 'view'
"""
VIEWS["routed"] = """
  SELECT request_id, user_id, top_k, status, arm, coalesce(drawn, arm) AS ab_test_group,
         CASE WHEN status <> 200 THEN NULL WHEN arm = 'baseline' THEN 'baseline'
              WHEN user_id NOT IN (SELECT user_id FROM train) THEN 'fallback'
              WHEN coalesce(use_rerank, true) THEN 'rerank' ELSE 'als' END AS model_type
  FROM (
    SELECT *, CASE WHEN drawn = 'baseline' OR use_baseline THEN 'baseline' ELSE 'als' END AS arm
    FROM (
      SELECT *, CAST(CASE WHEN top_k NOT BETWEEN 1 AND 500 THEN 400 WHEN user_id < 0 THEN 404 ELSE 200 END AS INTEGER) AS status,
             CASE WHEN ab_test_group = 'auto'
                  THEN CASE WHEN CAST('0x' || substr(md5(CAST(request_id AS VARCHAR)), 1, 8) AS BIGINT) % 2 = 0
                            THEN 'baseline' ELSE 'als' END
                  ELSE ab_test_group END AS drawn
      FROM requests))
"""
VIEWS["candidates"] = """
  SELECT u.user_id, p.item_id, p.score, row_number() OVER (PARTITION BY u.user_id ORDER BY p.pop_rank) AS cand_rank
  FROM (SELECT DISTINCT user_id FROM routed WHERE model_type IN ('als', 'rerank')) u CROSS JOIN popular p
  WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = u.user_id AND t.item_id = p.item_id)
"""
VIEWS["personal"] = """
  SELECT user_id, top_k, reranked, item_id, score, CAST(rank AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, top_k, reranked ORDER BY cand_rank) AS rank,
           CASE WHEN first < (SELECT count(DISTINCT item_id) FROM train)
                THEN first + 2 * greatest(top_k - got, 0) ELSE first END AS depth
    FROM (
      SELECT l.*, c.item_id, c.score, c.cand_rank, l.top_k * 3 AS first, b.item_id IS NOT NULL AS bought,
             count(*) FILTER (b.item_id IS NULL AND c.cand_rank <= l.top_k * 3)
               OVER (PARTITION BY l.user_id, l.top_k, l.reranked) AS got
      FROM (SELECT DISTINCT user_id, top_k, model_type = 'rerank' AS reranked FROM routed WHERE model_type IN ('als', 'rerank')) l
      JOIN candidates c ON c.user_id = l.user_id
      LEFT JOIN purchased b ON b.user_id = c.user_id AND b.item_id = c.item_id)
    WHERE NOT bought)
  WHERE cand_rank <= depth AND (cand_rank <= first OR rank <= top_k)
"""
VIEWS["serving_lists"] = """
  SELECT user_id, top_k, reranked, item_id, score, rank FROM personal WHERE NOT reranked AND rank <= top_k
  UNION ALL
  SELECT user_id, top_k, reranked, item_id, score, CAST(new AS INTEGER) FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, top_k ORDER BY w_rank * (1.0::DOUBLE / rank) + w_category * category_score DESC, rank) AS new
    FROM (
      SELECT p.*,
        CASE WHEN coalesce(h.n, 0) < 5 THEN 0.3::DOUBLE WHEN coalesce(h.n, 0) < 20 THEN 0.5::DOUBLE ELSE 0.6::DOUBLE END AS w_rank,
        CASE WHEN coalesce(h.n, 0) < 5 THEN 0.7::DOUBLE WHEN coalesce(h.n, 0) < 20 THEN 0.5::DOUBLE ELSE 0.4::DOUBLE END AS w_category,
        CASE WHEN c.category_id IS NULL THEN 0.0::DOUBLE
             WHEN t.category_id IS NOT NULL THEN 1.0::DOUBLE
             ELSE 0.2::DOUBLE * coalesce(s.n_events / (SELECT max(n_events)::DOUBLE FROM cat_stats), 0.0::DOUBLE) END AS category_score
      FROM personal p LEFT JOIN item_categories c ON c.item_id = p.item_id
      LEFT JOIN cat_stats s ON s.category_id = c.category_id
      LEFT JOIN (SELECT user_id, count(*) AS n FROM full_history GROUP BY 1) h ON h.user_id = p.user_id
      LEFT JOIN (SELECT user_id, category_id FROM (
                   SELECT user_id, category_id, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, category_id) AS r
                   FROM full_history WHERE category_id IS NOT NULL GROUP BY 1, 2) WHERE r <= 3) t
        ON t.user_id = p.user_id AND t.category_id = c.category_id
      WHERE p.reranked)) WHERE new <= top_k
"""
