"""Loads, sketches, panes and the dashboard table: parts put together equal the whole, and repeats change nothing."""

import random

import pytest
from conftest import values

from cartlens.operators import features, monitoring, sketches, validation
from cartlens.plans import incremental
from cartlens.streaming import alerts, dashboard, monitors
from pyspark.sql import functions as F

START = 1_400_000_000_000
DAY = 86_400_000
EVENTS = "timestamp bigint, user_id bigint, item_id bigint, event string, transaction_id string"
PROPERTIES = "timestamp bigint, item_id bigint, property string, value string"


def shop(seed=1):
    rnd = random.Random(seed)
    events = [
        (START + rnd.randrange(200) * DAY, rnd.randrange(-1, 20), rnd.choice([None, *range(1, 15)]), rnd.choice(["view", "addtocart", "transaction", "other"]), None)
        for _ in range(400)
    ]
    properties = [(START + rnd.randrange(5) * DAY, rnd.randrange(1, 15), "categoryid", str(rnd.randrange(3, 6))) for _ in range(60)]
    properties += [(START + rnd.randrange(5) * DAY, rnd.randrange(1, 15), "available", rnd.choice(["0", "1", None])) for _ in range(40)]
    return events, properties


def test_two_loads_equal_one_build(spark, frame, tmp_path):
    events, properties = shop()
    tree = frame([(1, None), (3, 1), (4, 1), (5, 4)], "category_id bigint, parent_id bigint")
    state = f"{tmp_path}/state"
    load = lambda name, e, p: incremental.load(spark, state, name, e and frame(e, EVENTS), p and frame(p, PROPERTIES))
    assert incremental.manifest(spark, state)["number"] == 0
    assert load("a", events[:250], properties[:50])
    assert load("b", events[200:], None)  # fifty rows come again, in the same spans
    assert load("c", None, properties[40:])
    before = incremental.manifest(spark, state)
    assert not load("b", events[200:], properties[:10]) and incremental.manifest(spark, state) == before
    clean, known = validation.clean_events(frame(events, EVENTS)), validation.clean_item_properties(frame(properties, PROPERTIES))
    categories, popularity = features.latest_categories(known), features.item_popularity(clean)
    availability, levels = features.item_availability(known), features.category_levels(tree)
    made = incremental.tables(spark, state, tree)
    want = {
        "item_availability": availability,
        "item_popularity": popularity,
        "category_tree": features.tree_with_levels(tree),
        "category_stats": features.category_stats(clean, categories),
        "item_metadata": features.item_metadata(categories, levels, availability, popularity),
    }
    assert set(made) == set(want)
    for name, table in want.items():
        assert values(made[name], *table.columns) == values(table), name


def test_a_broken_load_leaves_no_trace(spark, frame, tmp_path, monkeypatch):
    events, properties = shop(2)
    state, tree = f"{tmp_path}/state", frame([(3, None)], "category_id bigint, parent_id bigint")
    incremental.load(spark, state, "a", frame(events[:200], EVENTS), frame(properties, PROPERTIES))
    first = values(incremental.tables(spark, state, tree)["item_popularity"])

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(incremental.artifacts, "save_json", fails)
        with pytest.raises(OSError):
            incremental.load(spark, state, "b", frame(events[200:], EVENTS))
    assert values(incremental.tables(spark, state, tree)["item_popularity"]) == first
    assert incremental.load(spark, state, "b", frame(events[200:], EVENTS))
    clean = validation.clean_events(frame(events, EVENTS))
    assert values(incremental.tables(spark, state, tree)["item_popularity"]) == values(features.item_popularity(clean))


def test_no_load_gives_empty_tables(spark, frame, tmp_path):
    made = incremental.tables(spark, f"{tmp_path}/none", frame([(3, None)], "category_id bigint, parent_id bigint"))
    assert [made[n].count() for n in ("item_metadata", "category_stats", "item_popularity", "category_tree")] == [0, 0, 0, 1]


def test_sketches_of_parts_equal_those_of_the_whole(spark, frame, tmp_path):
    clean = validation.clean_events(frame(shop(3)[0], EVENTS))
    categories = frame([(i, i % 3) for i in range(1, 15)], "item_id bigint, category_id bigint")
    exact = values(features.category_stats(clean, categories))
    folder = f"{tmp_path}/audience"
    for part in (F.col("timestamp") % (2 * DAY) < DAY, F.col("timestamp") % (2 * DAY) >= DAY):
        for _ in range(2):
            sketches.save_spans(sketches.audience_sketches(clean.filter(part), categories), folder)
    assert values(sketches.audience(spark.read.parquet(folder))) == exact  # few enough users to be exact


def test_merged_quantiles_have_near_ranks(spark):
    log = spark.range(20_000).select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 3000).alias("ts"), (F.col("id") * 7919 % 20_000 / 20_000).alias("latency_s"))
    merged = sketches.merged_quantiles(sketches.latency_sketches(log), [F.lit(1).alias("all")]).first()
    assert merged["requests"] == 20_000
    assert all(abs(merged[name] - q) < 0.01 for name, q in sketches.LATENCY_QUANTILES.items())


@pytest.mark.parametrize("width,slide", [(300, 60), (300, 90), (60, 60)])
def test_panes_equal_sliding_windows(spark, width, slide):
    log = spark.range(500).select(
        F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.xxhash64("id"), F.lit(5000))).alias("ts"),
        F.element_at(F.array(*map(F.lit, ["click", "transaction", "impression"])), (F.col("id") % 3 + 1).cast("int")).alias("event"),
        F.lit("rerank").alias("model_type"),
        (F.col("id") % 7).cast("double").alias("revenue"),
    )
    copied = log.groupBy(F.window("ts", f"{width} seconds", f"{slide} seconds").alias("w")).agg(
        F.count(F.lit(1)).alias("requests"), F.coalesce(F.sum(F.when(F.col("event") == "transaction", F.col("revenue"))), F.lit(0.0)).alias("revenue")
    )
    want = values(copied.select(F.unix_millis("w.start").alias("window_start_ms"), "requests", "revenue"))
    assert values(monitoring.business_rates(log, width, slide), "window_start_ms", "requests", "revenue") == want
    assert values(monitoring.request_rates(log, width, slide), "window_start_ms", "requests") == [r[:2] for r in want]
    if width != slide:
        assert "Expand" not in monitoring.business_rates(log, width, slide)._jdf.queryExecution().executedPlan().toString()


def events_log(spark, folder, rows):
    spark.createDataFrame(rows, "s bigint, event string, revenue double").selectExpr(
        "timestamp_seconds(s) ts", "1L user_id", "1L item_id", "event", "revenue", "'als' model_type", "200 status", "'/events' endpoint", "0.1D latency_s", "false cold", "3L n_recs"
    ).write.mode("append").parquet(folder)


def test_dashboard_survives_a_killed_run(spark, tmp_path):
    """The second batch is published and then lost; its second run gives the same totals as the batch."""
    log, table = f"{tmp_path}/log", f"{tmp_path}/table"
    schema, publish, lost = "event_type string, n bigint, revenue double", dashboard.publisher(table), []

    def once(batch, number):
        publish(batch, number)
        if number == 1 and not lost:
            lost.append(number)
            raise OSError("killed after the write")

    for part in range(4):
        events_log(spark, log, [(1_704_067_200 + part * 100 + i, e, 2.0) for i, e in enumerate(["click", "transaction", "addtocart"][: 1 + part % 3])])
        for _ in range(2):
            run = monitors.write_dashboard(monitors.event_counters(monitors.read_log(spark, log)), once, f"{tmp_path}/progress", available_now=True)
            try:
                run.awaitTermination()
            except Exception:  # noqa: BLE001  the run that is killed
                assert lost == [1]
        if part == 2:
            assert dashboard.compact(spark, table, ["event_type"], schema) == 1
            assert dashboard.compact(spark, table, ["event_type"], schema) == -1
        assert values(dashboard.current(spark, table, ["event_type"], schema)) == values(monitoring.event_counters(spark.read.parquet(log)))
    assert lost == [1]


def test_watch_equals_the_batch_alerts(spark, tmp_path):
    """Bursts, silence and slow answers; the state is saved and read back after every minute."""
    rnd = random.Random(9)
    counts = {}
    for minute in range(400):
        if 150 < minute < 175 or rnd.random() < 0.1:
            continue
        n = rnd.choice([1, 40, 60]) if minute < 300 else 3
        slow = 0.9 if 200 < minute < 230 else 0.01
        latencies = [2.0 if rnd.random() < slow else 0.03 for _ in range(n)]
        upto = [sum(x <= b for x in latencies) for b in monitoring.LATENCY_BOUNDS]
        clicks = 0 if minute > 330 else n // 2
        counts[minute] = [n, clicks, clicks // 2, float(clicks), n if 90 < minute < 100 else 0, *upto, n]
    columns = ["minute", *alerts._COUNTS]
    kinds = ", ".join(f"{c} {'double' if c == 'revenue' else 'bigint'}" for c in columns)
    batch = monitoring.alerts(spark.createDataFrame([(k, *v) for k, v in counts.items()], kinds))
    saved, fired = None, []
    for minute, row in counts.items():
        watch = alerts.Watch(saved)
        fired += list(watch.add(minute, row))
        saved = watch.saved()
    rounded = lambda rows: sorted((a, m, round(v, 9), round(t, 9)) for a, m, v, t in rows)
    assert rounded(fired) == rounded(tuple(r) for r in batch.collect())
    assert {a for a, *_ in fired} == {name for name, _ in alerts._RULES}
