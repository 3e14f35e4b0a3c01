import pytest
from conftest import values

from cartlens.operators import abtest, monitoring, serving
from pyspark.sql import functions as F

EVENTS = "user_id bigint, item_id bigint, event string, model_type string, revenue double"


def test_arms_without_events(frame):
    totals = abtest.business_metrics(frame([(1, 1, "click", "fallback", 0.0)], EVENTS))
    assert values(totals, "model", "clicks", "ctr") == [("ALS", 0, 0.0), ("Baseline", 0, 0.0)]
    compared = abtest.compare_arms(totals)
    assert {(r["improvement_pct"], r["winner"]) for r in compared.collect()} == {(0.0, "Baseline")}


def test_comparison_rules(frame):
    rows = [(1, 1, "impression", "als", 0.0), (1, 1, "impression", "rerank", 0.0), (1, 1, "click", "als", 0.0)]
    rows += [(1, 1, "transaction", "rerank", 12.5), (1, 1, "impression", "baseline", 0.0)]
    compared = {r["metric"]: r for r in abtest.compare_arms(abtest.business_metrics(frame(rows, EVENTS))).collect()}
    assert (compared["ctr"]["als"], compared["ctr"]["improvement_pct"], compared["ctr"]["winner"]) == (0.5, 100.0, "ALS")
    assert compared["addtocart_rate"]["improvement_pct"] == 0.0
    no_model = frame(rows, EVENTS).drop("model_type")
    assert values(abtest.business_metrics(no_model), "model", "impressions") == [("ALS", 3), ("Baseline", 0)]


def test_summary_is_complete(frame):
    totals = abtest.business_metrics(frame([(1, 1, "impression", "als", 0.0)] * 1500, EVENTS))
    text = abtest.summary_text(abtest.summary_lines(totals, abtest.compare_arms(totals))).first()["summary"].split("\n")
    assert len(text) == 25 and text[5] == "  Impressions: 1,500"
    assert text[19].startswith("  CTR: ALS 0.0000 vs Baseline 0.0000 (+0.0%)")


def test_request_rules(frame):
    requests = frame(
        [(1, 5, 0, None, False, None), (2, -1, 10, None, False, None), (3, 5, 501, None, False, None),
         (4, 5, 10, True, False, "als"), (5, 6, 10, None, True, "als"), (6, 7, 10, None, False, "baseline"),
         (7, 8, 10, None, False, None), (8, 5, 500, False, False, None)],
        "request_id bigint, user_id bigint, top_k int, use_rerank boolean, use_baseline boolean, ab_test_group string",
    )
    routed = serving.route_requests(requests, frame([(5,), (6,)], "user_id bigint"))
    got = {r["request_id"]: (r["status"], r["model_type"], r["ab_test_group"]) for r in routed.collect()}
    assert got == {
        1: (400, None, "als"), 2: (404, None, "als"), 3: (400, None, "als"), 4: (200, "rerank", "als"),
        5: (200, "baseline", "als"), 6: (200, "baseline", "baseline"), 7: (200, "fallback", "als"), 8: (200, "als", "als"),
    }


def test_bought_items_are_made_up_for(frame):
    requests = frame([(1, 1, 2, False, False, "als")], "request_id bigint, user_id bigint, top_k int, use_rerank boolean, use_baseline boolean, ab_test_group string")
    routed = serving.route_requests(requests, frame([(1,)], "user_id bigint"))
    candidates = frame([(1, i, 1.0 / i, i) for i in range(1, 11)], "user_id bigint, item_id bigint, score double, cand_rank int")
    bought = frame([(1, i) for i in (1, 2, 3, 4, 6)], "user_id bigint, item_id bigint")
    cats = frame([], "item_id bigint, category_id bigint")
    lists = serving.personal_lists(
        routed, candidates, bought, F.lit(100), frame([], "user_id bigint, item_id bigint, category_id bigint"), cats,
        frame([], "category_id bigint, n_events bigint"), frame([], "category_id bigint, parent_id bigint"),
    )
    # six candidates leave only item 5; the next one free is 7
    assert values(lists, "rank", "item_id") == [(1, 5), (2, 7)]


def test_histogram_quantile_edges(frame, spark):
    log = spark.sql(
        "SELECT timestamp '2024-01-01 00:00:01' AS ts, v AS latency_s FROM VALUES (0.004D), (0.2D), (0.2D), (99.0D) AS t(v)"
    )
    row = monitoring.latency_quantiles(log).first()
    assert row["requests"] == 4
    assert row["p50"] == pytest.approx(0.1 + 0.15 * (2 - 1) / 2)
    assert row["p99"] == 10.0  # beyond the last bound


def test_drop_alert_needs_ten_minutes(spark):
    # two steady hours with revenue, then silence
    log = spark.sql(
        """SELECT timestamp_seconds(1704067200 + 60 * id) AS ts, 'transaction' AS event, 10.0D AS revenue, 200 AS status, 0.1D AS latency_s
           FROM range(240) WHERE id < 150 OR id = 239"""
    )
    fired = monitoring.alerts(monitoring.minute_counts(log))
    minutes = sorted(r["minute"] for r in fired.filter("alert = 'revenue_drop'").collect())
    start = 1704067200 // 60
    # from minute 151 the 5-minute sum is below 0.8 of the hour before; ten minutes later the alert fires
    assert minutes[0] == start + 151 + 9 and minutes == list(range(minutes[0], minutes[-1] + 1))
    assert fired.filter("alert = 'error_ratio'").count() == 0


def test_history_is_read_for_those_who_ask(frame, monkeypatch):
    requests = frame([(1, 1, 2, True, False, "als"), (2, 2, 2, False, False, "als")], "request_id bigint, user_id bigint, top_k int, use_rerank boolean, use_baseline boolean, ab_test_group string")
    routed = serving.route_requests(requests, frame([(1,), (2,)], "user_id bigint"))
    candidates = frame([(u, i, 1.0 / i, i) for u in (1, 2) for i in range(1, 21)], "user_id bigint, item_id bigint, score double, cand_rank int")
    history = frame([(u, i, 1) for u in (1, 2, 3, None) for i in range(3)], "user_id bigint, item_id bigint, category_id bigint")
    read = []
    rerank = serving.category_rerank
    monkeypatch.setattr(serving, "category_rerank", lambda recs, history, *a, **k: read.append(history) or rerank(recs, history, *a, **k))
    lists = serving.personal_lists(
        routed, candidates, frame([(2, 1)], "user_id bigint, item_id bigint"), F.lit(100), history, frame([(1, 1)], "item_id bigint, category_id bigint"),
        frame([(1, 4)], "category_id bigint, n_events bigint"), frame([], "category_id bigint, parent_id bigint"),
    )
    assert values(lists, "user_id", "rank", "item_id") == [(1, 1, 1), (1, 2, 2), (2, 1, 2), (2, 2, 3)]
    assert values(read[0].select("user_id").distinct()) == [(1,)]


def test_bought_items_are_marked_before_lists_share_candidates(spark, frame):
    """A candidate meets the purchases once, whatever lists take it, and the lists then stay by user in one shuffle."""
    routed = frame([(1, 5, k, m) for k in (1, 2) for m in ("als", "rerank")] + [(2, 6, 2, "als")], "request_id bigint, user_id bigint, top_k int, model_type string")
    candidates = frame([(u, i, 1.0 / i, i) for u in (5, 6) for i in range(1, 9)], "user_id bigint, item_id bigint, score double, cand_rank int")
    pairs = "user_id bigint, item_id bigint"
    bought = frame([(5, 1), (5, 1), (5, 3), (6, None), (None, 2)], pairs)
    history = frame([(5, 1, 7)], pairs + ", category_id bigint")
    categories = frame([(i, 7) for i in range(1, 9)], "item_id bigint, category_id bigint")
    stats = frame([(7, 3, 1, 1)], "category_id bigint, n_events bigint, n_users bigint, n_items bigint")
    tree = frame([(7, None)], "category_id bigint, parent_id bigint")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        lists = serving.personal_lists(routed, candidates, bought, F.lit(100), history, categories, stats, tree)
        got = values(lists, "user_id", "top_k", "reranked", "rank", "item_id")
        plan = lists._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    one, two = [(1, 2)], [(1, 2), (2, 4)]
    expected = [(5, k, r, *e) for k, entries in ((1, one), (2, two)) for r in (False, True) for e in entries]
    assert got == sorted(expected + [(6, 2, False, 1, 1), (6, 2, False, 2, 2)])
    lines = plan.splitlines()
    below = zip(lines, lines[2:])  # a window, its sort, and what deals the rows
    assert not any("Window [" in a and "Exchange hashpartitioning(user_id" in b and "top_k" in b for a, b in below)
