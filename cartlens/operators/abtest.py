"""A/B arms, business metrics and usage statistics over served requests and business events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.functions.columns import ratio

# Arms, event names, compared metrics and the layout of the text report.
ARMS = ("ALS", "Baseline")
PERSONAL_MODELS = ("als", "rerank")
BUSINESS_EVENTS = ("click", "addtocart", "transaction")
COMPARED = ("ctr", "conversion_rate", "addtocart_rate", "revenue")
COMPARISON_LINE = "  %s: ALS %.4f vs Baseline %.4f (%+.1f%%) - Winner: %s"
RATE_LINE = "  %s: %.4f (%.2f%%)"


def adapt_service_log(events: DataFrame) -> DataFrame:
    """Service logs name the event ``event_type``; the analysis reads ``event``."""
    if "event" not in events.columns and "event_type" in events.columns:
        return events.withColumnRenamed("event_type", "event")
    return events


def with_arm(events: DataFrame) -> DataFrame:
    """``arm``: ALS for als and rerank, Baseline for baseline, null otherwise; all ALS when models are unknown."""
    if "model_type" not in events.columns:
        return events.withColumn("arm", F.lit("ALS"))
    model = F.col("model_type")
    return events.withColumn(
        "arm", F.when(model.isin(*PERSONAL_MODELS), F.lit("ALS")).when(model == "baseline", F.lit("Baseline"))
    )


def business_metrics(events: DataFrame) -> DataFrame:
    """One row per arm, zeros for an arm without events. Both arms come from one global aggregate."""
    tagged = with_arm(adapt_service_log(events))
    revenue = F.col("revenue") if "revenue" in tagged.columns else F.lit(0.0)
    arms = []
    for arm in ARMS:
        mine = F.col("arm") == arm

        def n(event: str):
            return F.count(F.when(mine & (F.col("event") == event), F.lit(1)))

        arms.append(
            F.struct(
                F.lit(arm).alias("model"),
                n("impression").alias("impressions"),
                n("click").alias("clicks"),
                n("addtocart").alias("addtocart"),
                n("transaction").alias("transactions"),
                F.coalesce(F.sum(F.when(mine & (F.col("event") == "transaction"), revenue)), F.lit(0.0)).alias("revenue"),
            )
        )
    counts = tagged.agg(F.array(*arms).alias("arms")).select(F.inline("arms"))
    shown = F.col("impressions")
    return (
        counts.withColumn("ctr", ratio(F.col("clicks"), shown))
        .withColumn("conversion_rate", ratio(F.col("transactions"), shown))
        .withColumn("addtocart_rate", ratio(F.col("addtocart"), shown))
    )


def compare_arms(metrics: DataFrame) -> DataFrame:
    """(metric, als, baseline, improvement_pct, winner); the ALS arm wins only when strictly larger."""
    long = metrics.unpivot(["model"], list(COMPARED), "metric", "value")
    sides = long.groupBy("metric").agg(
        F.max(F.when(F.col("model") == "ALS", F.col("value"))).alias("als"),
        F.max(F.when(F.col("model") == "Baseline", F.col("value"))).alias("baseline"),
    )
    als, baseline = F.col("als"), F.col("baseline")
    return sides.withColumn(
        "improvement_pct",
        F.when(baseline > 0, (als - baseline) / baseline * 100.0)
        .when(als > 0, F.lit(100.0))
        .otherwise(F.lit(0.0)),
    ).withColumn("winner", F.when(als > baseline, F.lit("ALS")).otherwise(F.lit("Baseline")))


def comparison_lines(comparison: DataFrame) -> DataFrame:
    """(metric, line): the report's text line per compared metric."""
    return comparison.select(
        "metric",
        F.format_string(
            COMPARISON_LINE, F.upper("metric"), F.col("als"), F.col("baseline"), F.col("improvement_pct"), F.col("winner")
        ).alias("line"),
    )


def summary_lines(metrics: DataFrame, comparison: DataFrame) -> DataFrame:
    """(line_no, line): the whole text report. Two arms and four metrics, so it is a handful of rows."""
    rule = "=" * 80
    blocks = [(0, rule), (1, "A/B TEST RESULTS"), (2, rule), (3, ""), (10, ""), (17, ""), (18, "COMPARISON:"), (23, ""), (24, rule)]
    fixed = metrics.sparkSession.createDataFrame(blocks, "line_no int, line string")

    def rate(label: str, column: str):
        return F.format_string(RATE_LINE, F.lit(label), F.col(column), F.col(column) * 100)

    lines = F.array(
        F.format_string("%s model:", "model"),
        F.format_string("  Impressions: %,d", "impressions"),
        rate("CTR", "ctr"),
        rate("Conversion Rate", "conversion_rate"),
        rate("Add to Cart Rate", "addtocart_rate"),
        F.format_string("  Revenue: %.2f", "revenue"),
    )
    start = F.when(F.col("model") == "ALS", F.lit(4)).otherwise(F.lit(11))
    arms = metrics.select(F.posexplode(lines).alias("_p", "line"), start.alias("_s")).select(
        (F.col("_p") + F.col("_s")).alias("line_no"), "line"
    )
    place = F.array_position(F.array(*[F.lit(m) for m in COMPARED]), F.col("metric"))
    compared = comparison_lines(comparison).select((place + 18).cast("int").alias("line_no"), "line")
    return fixed.unionByName(arms).unionByName(compared)


def summary_text(lines: DataFrame) -> DataFrame:
    """The report as one text value."""
    entries = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.agg(F.array_join(F.transform(entries, lambda e: e["line"]), "\n").alias("summary"))


def usage_stats(served: DataFrame) -> DataFrame:
    """One row: answered requests by route."""
    model = F.col("model_type")

    def n(*names: str):
        return F.count(F.when(model.isin(*names), F.lit(1)))

    return served.filter(F.col("status") == 200).agg(
        F.count(F.lit(1)).alias("total_requests"),
        n("als").alias("personal_recommendations"),
        n("fallback").alias("popular_fallback"),
        n("rerank").alias("rerank_applied"),
        n("baseline").alias("baseline_recommendations"),
        n("als", "rerank").alias("als_requests"),
    )


def usage_business_metrics(served: DataFrame, events: DataFrame, shown: DataFrame) -> DataFrame:
    """One row: impressions of the answers, business events, and rates per impression."""
    event = F.col("event_type")
    impressions = shown.agg(F.coalesce(F.sum("impressions"), F.lit(0)).alias("n")).scalar()
    counts = events.agg(
        F.lit(impressions).alias("impressions"),
        F.count(F.when(event == "click", F.lit(1))).alias("clicks"),
        F.count(F.when(event == "addtocart", F.lit(1))).alias("addtocart"),
        F.count(F.when(event == "transaction", F.lit(1))).alias("transactions"),
        F.coalesce(F.sum(F.when(event == "transaction", F.col("revenue"))), F.lit(0.0)).alias("revenue"),
    )
    return counts.withColumn("ctr", ratio(F.col("clicks"), F.col("impressions"))).withColumn(
        "conversion_rate", ratio(F.col("transactions"), F.col("impressions"))
    )


def business_events(posted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) posted events; works on batch and streaming frames.

    Revenue defaults to 0 and the server time is set on arrival unless the log already carries it.
    """
    known = F.coalesce(F.col("event_type").isin(*BUSINESS_EVENTS), F.lit(False))
    filled = posted.withColumn("revenue", F.coalesce("revenue", F.lit(0.0)))
    if "ts" not in posted.columns:
        filled = filled.withColumn("ts", F.current_timestamp())
    return filled.filter(known), filled.filter(~known)
