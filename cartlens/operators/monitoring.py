"""Windowed monitoring of the request and event log.

Log columns: ts (timestamp), event (impression, click, addtocart, transaction, error), revenue, model_type, status,
endpoint, latency_s, cold, n_recs. The same functions run on batch and streaming logs; a streaming log takes its
watermark first. A rate is a count over the window's seconds, without counter-reset extrapolation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlens.functions.columns import ratio

# Histogram bounds and alert rules.
LATENCY_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)
COUNT_BOUNDS = (1.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0, 500.0)
ITEM_BOUNDS = (100.0, 500.0, 1000.0, 5000.0, 10000.0, 50000.0, 100000.0, 500000.0)
RATE_WINDOW_S = 300
COLD_WINDOW_S = 900
DROP_FACTOR = 0.8
MAX_ERROR_RATIO, MAX_P95_S, MIN_REQUEST_RATE = 0.1, 1.0, 0.1
SHORT_HOLD_MIN, LONG_HOLD_MIN = 5, 10

_MINUTE_MS = 60_000
_DAY_MINUTES = 1440
_LOOKBACK_MINUTES = 130  # two hours of baseline and ten minutes of hold


def _n(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def _event(name: str) -> Column:
    return F.col("event") == name


def _windowed(log: DataFrame, width_s: int, slide_s: int | None = None):
    slide = f"{slide_s} seconds" if slide_s else None
    return log.groupBy(F.window("ts", f"{width_s} seconds", slide).alias("w"))


def _start() -> Column:
    return F.unix_millis("w.start").alias("window_start_ms")


def _window_sums(log: DataFrame, width_s: int, slide_s: int | None, sums: list[Column]) -> DataFrame:
    """window_start_ms and sums per window. Sliding windows add up panes, so no row of the log is copied.

    A stream keeps Spark's sliding window, whose result can also be updated before it is final.
    """
    if slide_s is None or slide_s == width_s or log.isStreaming:
        windows = _windowed(log, width_s, slide_s).agg(*sums)
        return windows.select(_start(), *[c for c in windows.columns if c != "w"])
    panes = _windowed(log, math.gcd(width_s, slide_s)).agg(*sums)
    names = [c for c in panes.columns if c != "w"]
    width, slide = F.lit(width_s * 1000), F.lit(slide_s * 1000)
    at = F.unix_millis("w.start")
    first, last = (F.floor((at - width) / slide) + 1) * slide, F.floor(at / slide) * slide
    starts = panes.select(F.explode(F.sequence(first, last, slide.cast("long"))).alias("window_start_ms"), *names)
    return starts.groupBy("window_start_ms").agg(*[F.sum(c).alias(c) for c in names])


def request_rates(log: DataFrame, width_s: int = RATE_WINDOW_S, slide_s: int | None = 60) -> DataFrame:
    """Requests and re-ranked answers per second."""
    sums = [F.count(F.lit(1)).alias("requests"), _n(_event("impression") & (F.col("model_type") == "rerank")).alias("reranks")]
    return _window_sums(log, width_s, slide_s, sums).select(
        "window_start_ms",
        "requests",
        (F.col("requests") / width_s).alias("request_rate"),
        (F.col("reranks") / width_s).alias("rerank_rate"),
    )


def business_rates(log: DataFrame, width_s: int = RATE_WINDOW_S, slide_s: int | None = 60) -> DataFrame:
    """Click, conversion and cart rates per request, and revenue per second."""
    sums = [
        F.count(F.lit(1)).alias("requests"),
        _n(_event("click")).alias("clicks"),
        _n(_event("transaction")).alias("transactions"),
        _n(_event("addtocart")).alias("addtocart"),
        F.coalesce(F.sum(F.when(_event("transaction"), F.col("revenue"))), F.lit(0.0)).alias("revenue"),
    ]
    requests = F.col("requests")
    return _window_sums(log, width_s, slide_s, sums).select(
        "window_start_ms",
        "requests",
        ratio(F.col("clicks"), requests).alias("request_ctr"),
        ratio(F.col("transactions"), requests).alias("request_conversion"),
        ratio(F.col("addtocart"), requests).alias("request_cart_rate"),
        "revenue",
        (F.col("revenue") / width_s).alias("revenue_rate"),
    )


def request_label() -> Column:
    """The model label a request is counted under: posted events carry none."""
    return F.when(F.col("endpoint") == "/events", F.lit("unknown")).otherwise(F.coalesce("model_type", F.lit("unknown")))


def requests_by_model(log: DataFrame) -> DataFrame:
    return log.groupBy(request_label().alias("model_type")).agg(F.count(F.lit(1)).alias("requests"))


def errors_by_status(log: DataFrame, width_s: int = RATE_WINDOW_S) -> DataFrame:
    """Failed requests per second by window, status and endpoint.

    Every row stays in the aggregate, so on a stream good requests move the watermark too and close the windows.
    """
    counts = (
        log.groupBy(F.window("ts", f"{width_s} seconds").alias("w"), "status", "endpoint")
        .agg(_n(F.col("status") >= 400).alias("errors"))
        .filter(F.col("errors") > 0)
    )
    return counts.select(_start(), "status", "endpoint", "errors", (F.col("errors") / width_s).alias("error_rate"))


def cold_user_rate(log: DataFrame, width_s: int = COLD_WINDOW_S) -> DataFrame:
    """Cold answers by model in percent of all requests of the window; models without cold answers give no row.

    Any label counts, a missing one as `unknown`. The second aggregate holds one entry per label and window.
    """
    label = F.coalesce("model_type", F.lit("unknown"))
    by_model = log.groupBy(F.window("ts", f"{width_s} seconds").alias("w"), label.alias("model_type")).agg(
        F.count(F.lit(1)).alias("n"), _n(F.col("cold")).alias("cold_users")
    )
    counts = by_model.groupBy(F.window("w", f"{width_s} seconds").alias("w")).agg(
        F.sum("n").alias("requests"), F.collect_list(F.struct("model_type", "cold_users")).alias("arms")
    )
    return (
        counts.select(_start(), "requests", F.inline("arms"))
        .filter(F.col("cold_users") > 0)
        .withColumn("cold_pct", F.col("cold_users") / F.col("requests") * 100.0)
    )


def _bucket_counts(value: Column, bounds: tuple[float, ...]) -> list[Column]:
    """Cumulative counts per bound, and the total."""
    return [_n(value <= bound).alias(f"le_{i}") for i, bound in enumerate(bounds)] + [F.count(value).alias("le_all")]


def histogram_quantile(q: float, bounds: tuple[float, ...], prefix: str = "le_") -> Column:
    """Quantile of cumulative bucket counts, linear inside a bucket; the last bound beyond all buckets."""
    total = F.col(f"{prefix}all")
    rank = total * F.lit(q)
    value = F.lit(float(bounds[-1]))
    for i in reversed(range(len(bounds))):
        upto = F.col(f"{prefix}{i}")
        below = F.col(f"{prefix}{i - 1}") if i else F.lit(0)
        low = float(bounds[i - 1]) if i else 0.0
        inside = F.lit(low) + F.lit(float(bounds[i]) - low) * (rank - below) / F.nullif(upto - below, F.lit(0).cast("bigint"))
        value = F.when(upto >= rank, inside).otherwise(value)
    return F.when(total > 0, value)


def latency_quantiles(log: DataFrame, width_s: int = RATE_WINDOW_S) -> DataFrame:
    """p50, p95 and p99 seconds per window from bucket counts: a fixed-size, mergeable state per window."""
    counts = _windowed(log, width_s).agg(*_bucket_counts(F.col("latency_s"), LATENCY_BOUNDS)).filter(F.col("le_all") > 0)
    quantiles = [histogram_quantile(q, LATENCY_BOUNDS).alias(name) for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))]
    return counts.select(_start(), F.col("le_all").alias("requests"), *quantiles)


def approximate_latency(log: DataFrame, width_s: int = RATE_WINDOW_S, accuracy: int = 10_000) -> DataFrame:
    """Same quantiles from a bounded sketch, for values finer than the buckets."""
    sketch = F.percentile_approx("latency_s", [0.5, 0.95, 0.99], accuracy).alias("p")
    counts = _windowed(log, width_s).agg(F.count("latency_s").alias("requests"), sketch)
    return counts.select(
        _start(), "requests", *[F.element_at("p", i + 1).alias(name) for i, name in enumerate(("p50", "p95", "p99"))]
    )


def exact_latency_by_day(log: DataFrame) -> DataFrame:
    """Exact nearest-rank p50, p95 and p99 per day over whole milliseconds.

    Rows first combine to (day, millisecond) counts; a ladder over those short lists gives the quantiles.
    """
    counts = (
        log.filter(F.col("latency_s").isNotNull())
        .select(F.to_date("ts").alias("day"), F.round(F.col("latency_s") * 1000).cast("long").alias("ms"))
        .groupBy("day", "ms")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    day = Window.partitionBy("day")
    upto = day.orderBy("ms").rowsBetween(Window.unboundedPreceding, 0)
    ladder = counts.withColumn("_end", F.sum("_c").over(upto)).withColumn("_n", F.sum("_c").over(day))
    return ladder.groupBy("day").agg(
        F.max("_n").alias("requests"),
        *[
            F.min(F.when(F.col("_end") >= F.ceil(F.col("_n") * F.lit(q)), F.col("ms"))).alias(name)
            for name, q in (("p50_ms", 0.5), ("p95_ms", 0.95), ("p99_ms", 0.99))
        ],
    ).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def _histogram(df: DataFrame, value: Column, bounds: tuple[float, ...]) -> DataFrame:
    counts = df.agg(*_bucket_counts(value, bounds))
    labels = [(str(int(b)), f"le_{i}") for i, b in enumerate(bounds)] + [("+Inf", "le_all")]
    return counts.select(
        F.inline(F.array(*[F.struct(F.lit(label).alias("le"), F.col(c).alias("n")) for label, c in labels]))
    )


def recommendation_count_histogram(log: DataFrame) -> DataFrame:
    return _histogram(log, F.col("n_recs"), COUNT_BOUNDS)


def recommendation_count_quantiles(log: DataFrame, width_s: int = RATE_WINDOW_S) -> DataFrame:
    counts = _windowed(log, width_s).agg(*_bucket_counts(F.col("n_recs"), COUNT_BOUNDS)).filter(F.col("le_all") > 0)
    return counts.select(
        _start(), F.col("le_all").alias("answers"), *[histogram_quantile(q, COUNT_BOUNDS).alias(n) for n, q in (("p50", 0.5), ("p95", 0.95))]
    )


def item_id_histogram(items: DataFrame) -> DataFrame:
    return _histogram(items, F.col("item_id"), ITEM_BOUNDS)


def event_counters(log: DataFrame) -> DataFrame:
    """Running totals per business event; complete or update mode on a stream."""
    return (
        log.filter(F.col("event").isin("click", "addtocart", "transaction"))
        .groupBy(F.col("event").alias("event_type"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum(F.when(_event("transaction"), F.col("revenue"))), F.lit(0.0)).alias("revenue"),
        )
    )


def _minute_sums() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("requests"),
        _n(_event("click")).alias("clicks"),
        _n(_event("transaction")).alias("transactions"),
        F.coalesce(F.sum(F.when(_event("transaction"), F.col("revenue"))), F.lit(0.0)).alias("revenue"),
        _n(F.col("status") >= 500).alias("errors"),
        *_bucket_counts(F.col("latency_s"), LATENCY_BOUNDS),
    ]


def minute_counts(log: DataFrame) -> DataFrame:
    """Counts per minute: the only state alerts need, whatever the log's size."""
    return log.groupBy(F.floor(F.unix_millis("ts") / F.lit(_MINUTE_MS)).alias("minute")).agg(*_minute_sums())


def minute_windows(log: DataFrame) -> DataFrame:
    """The same over time windows, which a watermark can close."""
    counts = _windowed(log, 60).agg(*_minute_sums())
    minute = F.floor(F.unix_millis("w.start") / F.lit(_MINUTE_MS)).alias("minute")
    return counts.select(minute, *[c for c in counts.columns if c != "w"])


def alerts(minutes: DataFrame) -> DataFrame:
    """(alert, minute, value, threshold) for every minute an alert fires.

    Every minute between the first and last is judged, with or without traffic. Minutes are handled in daily chunks
    that repeat the lookback of the previous day, so no window spans the whole time line.
    """
    count_columns = [c for c in minutes.columns if c != "minute"]
    ends = minutes.agg(F.min("minute").alias("a"), F.max("minute").alias("b"))
    days = ends.filter(F.col("a").isNotNull()).select(
        "a", "b", F.explode(F.sequence(F.floor(F.col("a") / _DAY_MINUTES), F.floor(F.col("b") / _DAY_MINUTES))).alias("day")
    )
    grid = (
        days.select("a", "b", F.explode(F.sequence(F.col("day") * _DAY_MINUTES, F.col("day") * _DAY_MINUTES + _DAY_MINUTES - 1)).alias("minute"))
        .filter(F.col("minute").between(F.col("a"), F.col("b")))
        .select("minute")
    )
    filled = grid.join(minutes, "minute", "left").fillna(0, count_columns)
    day = F.floor(F.col("minute") / _DAY_MINUTES)
    late = F.col("minute") % _DAY_MINUTES >= _DAY_MINUTES - _LOOKBACK_MINUTES
    chunks = F.when(late, F.array(day, day + 1)).otherwise(F.array(day))
    by_chunk = Window.partitionBy("chunk").orderBy("minute")
    recent, earlier = by_chunk.rangeBetween(-4, 0), by_chunk.rangeBetween(-119, -60)

    def last5(column: str) -> Column:
        return F.sum(column).over(recent)

    def hour_before(column: str) -> Column:
        return F.sum(column).over(earlier)

    def share(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top / bottom)

    sums = filled.withColumn("chunk", F.explode(chunks)).withColumn("day", day)
    buckets = [c for c in count_columns if c.startswith("le_")]
    sums = sums.select(
        "minute",
        "day",
        "chunk",
        share(last5("clicks"), last5("requests")).alias("ctr"),
        share(hour_before("clicks"), hour_before("requests")).alias("ctr_before"),
        share(last5("transactions"), last5("requests")).alias("conversion"),
        share(hour_before("transactions"), hour_before("requests")).alias("conversion_before"),
        (last5("revenue") / 300.0).alias("revenue_rate"),
        (hour_before("revenue") / 3600.0).alias("revenue_rate_before"),
        share(last5("errors"), last5("requests")).alias("error_ratio"),
        (last5("requests") / 300.0).alias("request_rate"),
        *[last5(c).alias(c) for c in buckets],
    ).withColumn("p95", histogram_quantile(0.95, LATENCY_BOUNDS))
    # (name, value, threshold, breached, minutes to hold)
    rules = [
        (name, F.col(value), F.col(f"{value}_before") * DROP_FACTOR, LONG_HOLD_MIN)
        for name, value in (("ctr_drop", "ctr"), ("conversion_drop", "conversion"), ("revenue_drop", "revenue_rate"))
    ]
    judged = [(n, v, t, v < t, hold) for n, v, t, hold in rules] + [
        ("error_ratio", F.col("error_ratio"), F.lit(MAX_ERROR_RATIO), F.col("error_ratio") > MAX_ERROR_RATIO, SHORT_HOLD_MIN),
        ("latency_p95", F.col("p95"), F.lit(MAX_P95_S), F.col("p95") > MAX_P95_S, SHORT_HOLD_MIN),
        ("low_request_rate", F.col("request_rate"), F.lit(MIN_REQUEST_RATE), F.col("request_rate") < MIN_REQUEST_RATE, LONG_HOLD_MIN),
    ]
    held = sums
    for name, _, _, breached, hold in judged:
        flag = F.when(F.coalesce(breached, F.lit(False)), F.lit(1)).otherwise(F.lit(0))
        steps = by_chunk.rangeBetween(-(hold - 1), 0)
        held = held.withColumn(f"_{name}", flag).withColumn(f"_{name}_for", F.sum(f"_{name}").over(steps))
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("alert"),
                value.cast("double").alias("value"),
                threshold.cast("double").alias("threshold"),
                (F.col(f"_{name}_for") == hold).alias("_fires"),
            )
            for name, value, threshold, _, hold in judged
        ]
    )
    return (
        held.filter(F.col("chunk") == F.col("day"))
        .select("minute", F.inline(entries))
        .filter(F.col("_fires"))
        .select("alert", "minute", "value", "threshold")
    )
