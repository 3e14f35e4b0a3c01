from conftest import values

from cartlens.operators import diversity, popular, rerank
from cartlens.operators.transforms import filter_purchased_categories
from pyspark.sql import functions as F

RECS = "user_id bigint, item_id bigint, rank int"
CATS = "item_id bigint, category_id bigint"
POOL = "category_id bigint, pos int, item_id bigint"
POP = "item_id bigint, score double, pop_rank int"


def test_cap_and_refill_with_rank_collision(frame):
    recs = frame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (1, 13, 4), (1, 50, 5)], RECS)
    cats = frame([(10, 1), (11, 1), (12, 1), (13, 1), (50, None), (20, 2), (21, 2), (30, 3)], CATS)
    pool = frame([(1, 1, 14), (2, 1, 20), (2, 2, 21), (3, 1, 30)], POOL)
    out = diversity.apply_diversity_constraint(recs, cats, 2, pool)
    # kept 10, 11, 50 (ranks 1, 2, 5); fills 20 and 21 get ranks 4 and 5; 50 wins its tie with 21
    assert [r["item_id"] for r in out.orderBy("rank").collect()] == [10, 11, 20, 50, 21]
    assert [r["rank"] for r in out.orderBy("rank").collect()] == [1, 2, 3, 4, 5]
    capped = diversity.apply_diversity_constraint(recs, cats, 2)
    assert [r["item_id"] for r in capped.orderBy("rank").collect()] == [10, 11, 50]


def test_refill_skips_present_items_and_runs_short(frame):
    recs = frame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (1, 60, 4)], RECS)
    cats = frame([(10, 1), (11, 1), (12, 1)], CATS)
    pool = frame([(2, 1, 60), (1, 1, 99)], POOL)
    out = diversity.apply_diversity_constraint(recs, cats, 1, pool)
    assert [r["item_id"] for r in out.orderBy("rank").collect()] == [10, 60]


def test_list_longer_than_promised_fails(frame):
    recs = frame([(1, i, i) for i in range(1, 5)], RECS)
    pool = frame([(2, 1, 60)], POOL)
    try:
        diversity.apply_diversity_constraint(recs, frame([(1, 1)], CATS), 1, pool, list_size=3).collect()
    except Exception as error:  # raised inside a task
        assert "list_size" in str(error)
    else:
        raise AssertionError("expected a failure")


def test_adaptive_thresholds(frame):
    lengths = {1: 0, 2: 4, 3: 5, 4: 19, 5: 20}
    history = frame([(u, i, 1) for u, n in lengths.items() for i in range(n)], "user_id bigint, item_id bigint, category_id bigint")
    users = frame([(u,) for u in lengths], "user_id bigint")
    out = rerank.adaptive_weights(history, users, 0.7, 0.3)
    assert values(out) == [(1, 0, 0.3, 0.7), (2, 4, 0.3, 0.7), (3, 5, 0.5, 0.5), (4, 19, 0.5, 0.5), (5, 20, 0.7, 0.3)]


def test_rerank_scores_same_near_other_and_none(frame):
    recs = frame([(1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 4, 4), (1, 5, 5)], RECS)
    meta = frame([(1, 30), (2, None), (3, 10), (4, 20), (5, 40), (9, 20)], CATS)
    history = frame([(1, 9, 20)], "user_id bigint, item_id bigint, category_id bigint")
    stats = frame([(30, 10), (20, 5), (40, 1)], "category_id bigint, n_events bigint")
    tree = frame([(20, 10), (40, 20), (10, None)], "category_id bigint, parent_id bigint")
    scored = rerank.score_candidates(recs, history, meta, stats, tree, adaptive=False, alpha=0.0, beta=1.0)
    assert {r["item_id"]: round(r["final_score"], 6) for r in scored.collect()} == {1: 0.2, 2: 0.0, 3: 0.5, 4: 1.0, 5: 0.5}
    best = rerank.category_rerank(recs, history, meta, stats, tree, top_k=3, adaptive=False, alpha=0.0, beta=1.0)
    assert values(best, "rank", "item_id") == [(1, 4), (2, 3), (3, 5)]


def test_zero_popularity_and_zero_rank(frame):
    stats = frame([(1, 0), (2, 0)], "category_id bigint, n_events bigint")
    assert values(rerank.normalised_popularity(stats)) == [(1, 0.0), (2, 0.0)]
    recs = frame([(1, 1, 0)], RECS)
    history = frame([], "user_id bigint, item_id bigint, category_id bigint")
    scored = rerank.score_candidates(recs, history, frame([(1, 1)], CATS), stats)
    assert scored.first()["final_score"] == 0.0


def test_bought_categories(frame):
    recs = frame([(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 1, 1)], RECS)
    meta = frame([(1, 10), (2, 20), (9, 10)], CATS)
    bought = frame([(1, 9)], "user_id bigint, item_id bigint")
    assert values(filter_purchased_categories(recs, bought, meta)) == [(1, 2, 2), (1, 3, 3), (2, 1, 1)]
    assert filter_purchased_categories(recs, bought, meta, [20]).count() == 4
    assert filter_purchased_categories(recs, bought, meta, []).count() == 3


def test_cold_lists(frame):
    pop = frame([(i, 10.0 - i, i) for i in range(1, 6)], POP)
    meta = frame([(1, 100), (2, 200), (3, 100), (4, 200), (5, 200)], CATS)
    users = frame([(1,), (2,)], "user_id bigint")
    events = frame([(1, 4)], "user_id bigint, item_id bigint")
    out = popular.popular_by_user_categories(users, pop, meta, events, 3)
    # head is 1, 2, 3; user 1 likes category 200, so 2 leads, then the list in order
    assert values(out, "user_id", "rank", "item_id") == [(1, 1, 2), (1, 2, 1), (1, 3, 3), (2, 1, 1), (2, 2, 2), (2, 3, 3)]
    short = popular.popular_for_users(users, frame([(7, 1.0, 1)], POP), 20)
    assert values(short) == [(1, 7, 1), (2, 7, 1)]
    assert popular.popular_for_users(users, frame([], POP), 20).count() == 0


def test_popular_ties_by_id(frame):
    inter = frame([(5, 1.0), (4, 1.0), (6, 3.0)], "item_id bigint, rating double")
    assert values(popular.top_popular_items(inter, 2), "pop_rank", "item_id") == [(1, 6), (2, 4)]
    no_carts = frame([(1, "view")], "item_id bigint, event string")
    assert popular.top_popular_items_by_cart(no_carts, 5).count() == 0


def test_popular_lists_are_dealt_to_several_tasks(frame):
    """A list per user is a hundred times the user's bytes, so the few bytes of the users do not set the tasks."""
    top = frame([(i, float(100 - i), i) for i in range(1, 101)], "item_id bigint, score double, pop_rank int")
    users = frame([(u,) for u in range(400)], "user_id bigint")
    listed = popular.popular_for_users(users, top, 100)
    assert listed.count() == 40_000
    assert listed.select(F.spark_partition_id().alias("p")).distinct().count() == 4
