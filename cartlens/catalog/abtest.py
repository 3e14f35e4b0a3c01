"""A/B comparison over the log."""

from pyspark.sql import functions as F

from cartlens.catalog.registry import query
from cartlens.operators import abtest

_ARM = "CASE WHEN model_type IN ('als', 'rerank') THEN 'ALS' WHEN model_type = 'baseline' THEN 'Baseline' END"


@query("ab_arms", f"SELECT {_ARM} AS arm, event, count(*) AS n FROM rec_log GROUP BY 1, 2")
def _(s):
    return abtest.with_arm(s.log).groupBy("arm", "event").agg(F.count(F.lit(1)).alias("n"))


_METRICS = f"""
ab AS (
  SELECT *, CASE WHEN impressions > 0 THEN clicks / impressions::DOUBLE ELSE 0 END AS ctr,
         CASE WHEN impressions > 0 THEN transactions / impressions::DOUBLE ELSE 0 END AS conversion_rate,
         CASE WHEN impressions > 0 THEN addtocart / impressions::DOUBLE ELSE 0 END AS addtocart_rate
  FROM (
    SELECT arm AS model, count(*) FILTER (event = 'impression') AS impressions, count(*) FILTER (event = 'click') AS clicks,
           count(*) FILTER (event = 'addtocart') AS addtocart, count(*) FILTER (event = 'transaction') AS transactions,
           coalesce(sum(revenue) FILTER (event = 'transaction'), 0) AS revenue
    FROM (SELECT {_ARM} AS arm, event, revenue FROM rec_log) WHERE arm IS NOT NULL GROUP BY 1)),
cmp AS (
  SELECT metric, als, baseline,
         CASE WHEN baseline > 0 THEN (als - baseline) / baseline * 100.0::DOUBLE WHEN als > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS improvement_pct,
         CASE WHEN als > baseline THEN 'ALS' ELSE 'Baseline' END AS winner
  FROM (SELECT a.metric, a.value AS als, b.value AS baseline
        FROM (SELECT metric, value FROM (SELECT ctr, conversion_rate, addtocart_rate, revenue FROM ab WHERE model = 'ALS')
                UNPIVOT (value FOR metric IN (ctr, conversion_rate, addtocart_rate, revenue))) a
        JOIN (SELECT metric, value FROM (SELECT ctr, conversion_rate, addtocart_rate, revenue FROM ab WHERE model = 'Baseline')
                UNPIVOT (value FOR metric IN (ctr, conversion_rate, addtocart_rate, revenue))) b USING (metric)))"""


@query(
    "ab_business_metrics",
    f"""WITH {_METRICS}
SELECT model, impressions, clicks, addtocart, transactions, round(revenue, 6) AS revenue, round(ctr, 6) AS ctr,
       round(conversion_rate, 6) AS conversion_rate, round(addtocart_rate, 6) AS addtocart_rate FROM ab""",
)
def _(s):
    return abtest.business_metrics(s.log)


@query(
    "ab_comparison",
    f"""WITH {_METRICS}
SELECT metric, round(als, 6) AS als, round(baseline, 6) AS baseline, round(improvement_pct, 6) AS improvement_pct, winner FROM cmp""",
)
def _(s):
    return abtest.compare_arms(abtest.business_metrics(s.log))


_LINE = """printf('  %s: ALS %.4f vs Baseline %.4f (%+.1f%%) - Winner: %s', upper(metric), als, baseline, improvement_pct, winner)"""


@query("ab_comparison_lines", f"WITH {_METRICS} SELECT metric, {_LINE} AS line FROM cmp")
def _(s):
    return abtest.comparison_lines(abtest.compare_arms(abtest.business_metrics(s.log)))


@query(
    "ab_summary_lines",
    f"""WITH {_METRICS}
SELECT CAST(line_no AS INTEGER) AS line_no, line FROM (
  SELECT * FROM (VALUES (0, repeat('=', 80)), (1, 'A/B TEST RESULTS'), (2, repeat('=', 80)), (3, ''),
                        (10, ''), (17, ''), (18, 'COMPARISON:'), (23, ''), (24, repeat('=', 80))) v(line_no, line)
  UNION ALL
  SELECT o + i, CASE i WHEN 0 THEN model || ' model:'
                       WHEN 1 THEN '  Impressions: ' || format('{{:,}}', impressions)
                       WHEN 2 THEN printf('  CTR: %.4f (%.2f%%)', ctr, ctr * 100)
                       WHEN 3 THEN printf('  Conversion Rate: %.4f (%.2f%%)', conversion_rate, conversion_rate * 100)
                       WHEN 4 THEN printf('  Add to Cart Rate: %.4f (%.2f%%)', addtocart_rate, addtocart_rate * 100)
                       ELSE printf('  Revenue: %.2f', revenue) END
  FROM (SELECT *, CASE WHEN model = 'ALS' THEN 4 ELSE 11 END AS o FROM ab), range(6) r(i)
  UNION ALL
  SELECT 18 + list_position(['ctr', 'conversion_rate', 'addtocart_rate', 'revenue'], metric), {_LINE} FROM cmp)""",
)
def _(s):
    totals = abtest.business_metrics(s.log)
    return abtest.summary_lines(totals, abtest.compare_arms(totals))


@query(
    "business_events_accepted",
    """
SELECT user_id, item_id, event AS event_type, revenue, model_type FROM rec_log
WHERE event IN ('click', 'addtocart', 'transaction')""",
)
def _(s):
    accepted, _ = abtest.business_events(s.log.withColumnRenamed("event", "event_type"))
    return accepted.select("user_id", "item_id", "event_type", "revenue", "model_type")


@query(
    "business_events_rejected",
    """
SELECT event AS event_type, count(*) AS n FROM rec_log
WHERE event NOT IN ('click', 'addtocart', 'transaction') GROUP BY 1""",
)
def _(s):
    _, rejected = abtest.business_events(s.log.withColumnRenamed("event", "event_type"))
    return rejected.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
