from conftest import values

from cartlens.operators import monitoring
from cartlens.streaming import monitors

SQL = """
SELECT timestamp_seconds(s) AS ts, u AS user_id, 1L AS item_id, e AS event, r AS revenue, 'als' AS model_type,
       200 AS status, '/events' AS endpoint, 0.1D AS latency_s, false AS cold, 3L AS n_recs
FROM VALUES {rows} AS t(s, u, e, r)"""


def write(spark, folder, rows):
    text = ", ".join(f"({s}, {u}L, '{e}', {r}D)" for s, u, e, r in rows)
    spark.sql(SQL.format(rows=text)).coalesce(1).write.mode("append").parquet(folder)


def test_late_rows_are_dropped_by_the_stream_only(spark, tmp_path):
    folder = f"{tmp_path}/log"
    base = 1_704_067_200
    write(spark, folder, [(base + 10, 1, "click", 0.0), (base + 20, 1, "impression", 0.0)])
    write(spark, folder, [(base + 3600, 1, "impression", 0.0)])
    # rows are judged against the watermark of the batch before, so the late row comes one file later
    write(spark, folder, [(base + 7200, 1, "transaction", 5.0)])
    write(spark, folder, [(base + 30, 1, "click", 0.0), (base + 9000, 1, "impression", 0.0)])
    log = monitors.read_log(spark, folder, max_files=1)
    closed = monitors.run_available(monitors.business_rates(log, slide_s=None), "late")
    got = {r["window_start_ms"] // 1000 - base: r["requests"] for r in closed.collect()}
    assert got[0] == 2 and got[3600] == 1
    batch = monitoring.business_rates(spark.read.parquet(folder), slide_s=None)
    assert {r["window_start_ms"] // 1000 - base: r["requests"] for r in batch.collect()}[0] == 3


def test_counters_and_dashboard(spark, tmp_path):
    folder = f"{tmp_path}/log"
    write(spark, folder, [(1_704_067_200 + i, 1, e, 2.0) for i, e in enumerate(["click", "transaction", "transaction", "error"])])
    totals = monitors.run_available_totals(monitors.event_counters(monitors.read_log(spark, folder)), "totals")
    assert values(totals) == [("click", 1, 0.0), ("transaction", 2, 4.0)]


def test_business_events_are_split(spark, tmp_path):
    folder = f"{tmp_path}/posted"
    spark.sql(
        "SELECT * FROM VALUES (1L, 2L, 'click', CAST(NULL AS DOUBLE), 'als'), (1L, 2L, 'hover', 1.0D, 'als'), (1L, 2L, NULL, 1.0D, 'als') "
        "AS t(user_id, item_id, event_type, revenue, model_type)"
    ).write.parquet(folder)
    posted = spark.readStream.schema(monitors.POSTED_SCHEMA).parquet(folder)
    for query in monitors.split_business_events(posted, f"{tmp_path}/ok", f"{tmp_path}/bad", available_now=True):
        query.awaitTermination()
    accepted = spark.read.parquet(f"{tmp_path}/ok").collect()
    assert [(r["event_type"], r["revenue"], r["ts"] is not None) for r in accepted] == [("click", 0.0, True)]
    assert spark.read.parquet(f"{tmp_path}/bad").count() == 2


def test_business_events_survive_restarts(spark, tmp_path):
    """Three runs with one new file each lose and repeat nothing."""
    folder = f"{tmp_path}/posted"
    for i in range(3):
        rows = [(i, 1, "click", 0.0, "als"), (i, 2, "hover", 0.0, "als")]
        spark.createDataFrame(rows, monitors.POSTED_SCHEMA).write.mode("append").parquet(folder)
        posted = spark.readStream.schema(monitors.POSTED_SCHEMA).parquet(folder)
        for query in monitors.split_business_events(posted, f"{tmp_path}/ok", f"{tmp_path}/bad", available_now=True):
            query.awaitTermination()
    assert sorted(r["user_id"] for r in spark.read.parquet(f"{tmp_path}/ok").collect()) == [0, 1, 2]
    assert sorted(r["user_id"] for r in spark.read.parquet(f"{tmp_path}/bad").collect()) == [0, 1, 2]


def test_good_traffic_closes_error_windows(spark, tmp_path):
    folder = f"{tmp_path}/log"
    schema = "ts timestamp, user_id bigint, item_id bigint, event string, revenue double, model_type string, status int, endpoint string, latency_s double, cold boolean, n_recs bigint"
    row = lambda minute, status, cold, label: (f"2026-01-01 {minute // 60:02d}:{minute % 60:02d}:00", status, cold, label)
    rows = [row(0, 500, False, "als"), row(1, 503, True, "als_v2"), row(2, 200, True, None)] + [row(m, 200, False, "als") for m in range(3, 240, 5)]
    log = spark.createDataFrame(rows, "ts string, status int, cold boolean, model_type string").selectExpr(
        "cast(ts as timestamp) ts", "1L user_id", "1L item_id", "'impression' event", "0D revenue", "model_type", "status", "'/r' endpoint", "0.1D latency_s", "cold", "1L n_recs"
    )
    log.write.parquet(folder)
    stream = monitors.read_log(spark, folder)
    assert stream.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
    errors = monitors.run_available(monitors.errors_by_status(stream), "errors-test")
    assert sorted((r["status"], r["errors"]) for r in errors.collect()) == [(500, 1), (503, 1)]
    cold = monitors.run_available(monitors.cold_user_rate(stream), "cold-test")
    assert sorted((r["model_type"], r["cold_users"], r["requests"]) for r in cold.collect()) == [("als_v2", 1, 6), ("unknown", 1, 6)]
