import math

import pytest
from conftest import values

from cartlens.operators import metrics as m

PAIRS = "user_id bigint, item_id bigint"
RECS = "user_id bigint, item_id bigint, rank int"
METRIC = "metric string, value double"


def test_quality_by_hand(frame):
    test = frame([(1, 10), (1, 11), (1, 10), (2, 20), (3, 30)], PAIRS)
    recs = frame([(1, 10, 1), (1, 99, 2), (2, 98, 1), (2, 20, 2), (4, 1, 1)], RECS)
    row = m.precision_recall_ndcg_at_k(test, recs, 2).first()
    assert row["precision@k"] == pytest.approx(0.5)
    assert row["recall@k"] == pytest.approx((0.5 + 1.0) / 2)
    second = 1 / math.log2(3)
    assert row["ndcg@k"] == pytest.approx((1 / (1 + second) + second) / 2)
    # user 3 has no list and still counts as a test user
    assert m.hit_rate_at_k(test, recs, 1).first()[0] == pytest.approx(1 / 3)


def test_no_common_users_and_bad_k(frame):
    test, recs = frame([(1, 1)], PAIRS), frame([(2, 1, 1)], RECS)
    assert tuple(m.precision_recall_ndcg_at_k(test, recs, 5).first()) == (0.0, 0.0, 0.0)
    empty = frame([], RECS)
    assert m.hit_rate_at_k(test, empty, 5).first()[0] == 0.0
    assert m.hit_rate_at_k(frame([], PAIRS), recs, 5).first()[0] == 0.0
    for call in (
        lambda: m.precision_recall_ndcg_at_k(test, recs, 0),
        lambda: m.hit_rate_at_k(test, recs, 0),
        lambda: m.coverage_at_k(recs, 1, 0),
        lambda: m.coverage_at_k(recs, 0, 5),
        lambda: m.novelty_at_k(recs, test, 0),
        lambda: m.diversity_at_k(recs, test, -1),
    ):
        with pytest.raises(ValueError):
            call()


def test_guardrails(frame):
    recs = frame([(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 7, 2)], RECS)
    train = frame([(1, 1), (2, 1), (3, 1), (3, 2)], PAIRS)
    assert m.coverage_at_k(recs, 2, 5).first()[0] == 1.0  # capped
    assert m.coverage_at_k(recs, 6, 1).first()[0] == pytest.approx(1 / 6)
    expected = (2 * -math.log2(3 / 4) + 2 * -math.log2(1 / 4)) / 4  # item 7 is unknown and counts once
    assert m.novelty_at_k(recs, train, 5).first()[0] == pytest.approx(expected)
    assert m.novelty_at_k(recs, frame([], PAIRS), 5).first()[0] == 0.0
    meta = frame([(1, 10), (2, 20)], "item_id bigint, category_id bigint")
    assert m.diversity_at_k(recs, meta, 5).first()[0] == pytest.approx(1.5)
    carts = frame([(1, 2, "addtocart"), (2, 1, "view")], "user_id bigint, item_id bigint, event string")
    assert m.cart_prediction_rate(carts, recs, 5).first()[0] == pytest.approx(0.5)
    assert m.cart_prediction_rate(carts.filter("event = 'view'"), recs, 5).first()[0] == 0.0


def test_degradation_edges(frame):
    old = frame([("recall@20", 1.0), ("ndcg@10", 1.0), ("precision@5", 0.0), ("novelty@k", 9.0)], METRIC)
    new = frame([("recall@20", 0.91), ("ndcg@10", 0.89), ("precision@5", 0.0), ("novelty@k", 1.0), ("hit_rate@5", 0.0)], METRIC)
    bad = m.check_degradation(new, old)
    assert values(bad, "metric") == [("ndcg@10",)]
    few, many = frame([(1, 1)], PAIRS), frame([(i, 1) for i in range(100)], PAIRS)
    assert m.degradation_gate(bad, few) is False
    with pytest.raises(m.ModelDegradation):
        m.degradation_gate(bad, many)
    assert m.degradation_gate(m.check_degradation(old, old), many) is True


def test_all_metrics_agree_with_single_ones(frame):
    test = frame([(u, (u * 7 + i) % 30) for u in range(1, 12) for i in range(3)], PAIRS)
    recs = frame([(u, (u * 5 + r) % 30, r) for u in range(3, 14) for r in range(1, 21)], RECS)
    got = {r["metric"]: r["value"] for r in m.compute_all_metrics(test, recs, test, 30, 5).collect()}
    for k, name in ((20, "recall"), (5, "precision"), (10, "ndcg")):
        one = m.precision_recall_ndcg_at_k(test, recs, k).first()
        assert got[f"{name}@{k}"] == pytest.approx(one[f"{name}@k"])
    assert all(0.0 <= v <= 1.0 for n, v in got.items() if not n.startswith("novelty"))


def test_all_metrics_share_their_passes_and_equal_the_single_ones(spark, frame):
    """The lists meet targets and carts in one join, and their items are counted once; nulls and repeats included."""
    pair = "user_id bigint, item_id bigint"
    test = frame([(1, 10), (1, 10), (1, 11), (2, 20), (3, None), (None, 10), (5, 50)], pair)
    events = [(1, 10, "addtocart"), (1, 12, "addtocart"), (1, 12, "addtocart"), (2, 20, "view"), (4, 40, "addtocart"), (6, 10, "addtocart"), (2, None, "addtocart")]
    carts = frame(events, pair + ", event string")
    lists = [(1, 10, 1), (1, 12, 2), (1, 11, 7), (2, 21, 1), (2, 20, 30), (4, 40, 6), (4, 10, 5), (None, 10, 1), (6, None, 1), (3, 10, None)]
    recs = frame(lists, pair + ", rank int")
    train = frame([(1, 12), (2, 12), (2, 10), (3, 40), (3, 99)], pair)
    categories = frame([(10, 1), (12, 1), (11, 2), (21, None)], "item_id bigint, category_id bigint")
    for counts in (None, m.item_counts(train)):
        out = m.compute_all_metrics(test, recs, train, 4, 5, categories, None, carts, counts)
        got = {r["metric"]: r["value"] for r in out.collect()}
        assert len(got) == 16
        for k in (5, 10, 20):
            one = m.precision_recall_ndcg_at_k(test, recs, k).first()
            for name in ("precision", "recall", "ndcg"):
                assert got.get(f"{name}@{k}", one[f"{name}@k"]) == pytest.approx(one[f"{name}@k"])
        for k in (5, 10):
            assert got[f"hit_rate@{k}"] == pytest.approx(m.hit_rate_at_k(test, recs, k).first()[0])
        assert got["coverage@k"] == pytest.approx(m.coverage_at_k(recs, 4, 5).first()[0])
        assert got["novelty@k"] == pytest.approx(m.novelty_at_k(recs, train, 5).first()[0])
        assert got["diversity@k"] == pytest.approx(m.diversity_at_k(recs, categories, 5).first()[0])
        assert 0 < got["cart_prediction_rate@5"] == pytest.approx(m.cart_prediction_rate(carts, recs, 5).first()[0])
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join ") <= 4  # lists and pairs, users and pairs, items and counts, categories
