"""Validation of events, properties and the category tree."""

from cartlens.catalog.registry import query
from cartlens.operators import validation as v


@query("events_clean", "SELECT timestamp, user_id, item_id, event, transaction_id FROM clean_events")
def _(s):
    return s.events


_FIRST_FAILURE = """
CASE WHEN user_id IS NULL OR item_id IS NULL OR timestamp IS NULL OR event IS NULL THEN 'null'
     WHEN event NOT IN ('view', 'addtocart', 'transaction') THEN 'event'
     WHEN timestamp NOT BETWEEN 1262304000000 AND 1893456000000 THEN 'timestamp'
     WHEN user_id <= 0 OR item_id <= 0 THEN 'id' END"""


@query(
    "events_validation_stats",
    f"""
SELECT stat, n FROM (
  SELECT count(*) AS initial_rows, count(*) FILTER (reason = 'null') AS nulls_removed,
         count(*) FILTER (reason = 'event') AS invalid_events,
         count(*) FILTER (reason = 'timestamp') AS invalid_timestamps,
         count(*) FILTER (reason = 'id') AS invalid_ids,
         count(*) FILTER (reason IS NULL) - (SELECT count(*) FROM clean_events) AS duplicates_removed,
         (SELECT count(*) FROM clean_events) AS final_rows
  FROM (SELECT {_FIRST_FAILURE} AS reason FROM rec_events)
) UNPIVOT (n FOR stat IN (initial_rows, nulls_removed, invalid_events, invalid_timestamps, invalid_ids,
                          duplicates_removed, final_rows))""",
)
def _(s):
    return v.validate_events(s.raw_events)[1]


@query(
    "events_pass_percent",
    """
SELECT (SELECT count(*) FROM rec_events) AS initial_rows, (SELECT count(*) FROM clean_events) AS final_rows,
       round((SELECT count(*) FROM clean_events) * 100.0::DOUBLE / (SELECT count(*) FROM rec_events), 6) AS pass_pct""",
)
def _(s):
    return v.pass_percent(v.validate_events(s.raw_events)[1])


@query(
    "events_rejected_by_reason",
    f"""
SELECT reason AS reject_reason, count(*) AS n FROM (SELECT {_FIRST_FAILURE} AS reason FROM rec_events)
WHERE reason IS NOT NULL GROUP BY 1""",
)
def _(s):
    from pyspark.sql import functions as F

    rejected = s.tagged_events.filter(F.col(v.REASON).isNotNull())
    return rejected.groupBy(v.REASON).agg(F.count(F.lit(1)).alias("n"))


@query("properties_clean", "SELECT timestamp, item_id, property, value FROM clean_properties")
def _(s):
    return s.properties


@query(
    "properties_validation_stats",
    """
SELECT stat, n FROM (
  SELECT count(*) AS initial_rows,
         count(*) FILTER (item_id IS NULL OR property IS NULL OR timestamp IS NULL) AS nulls_removed,
         count(*) FILTER (timestamp NOT BETWEEN 1262304000000 AND 1893456000000) AS invalid_timestamps,
         count(*) FILTER (timestamp BETWEEN 1262304000000 AND 1893456000000 AND item_id <= 0) AS invalid_ids,
         count(*) FILTER (timestamp BETWEEN 1262304000000 AND 1893456000000 AND item_id > 0)
           - (SELECT count(*) FROM clean_properties) AS duplicates_removed,
         (SELECT count(*) FROM clean_properties) AS final_rows
  FROM rec_properties
) UNPIVOT (n FOR stat IN (initial_rows, nulls_removed, invalid_timestamps, invalid_ids, duplicates_removed, final_rows))""",
)
def _(s):
    return v.validate_item_properties(s.raw_properties)[1]


@query("category_tree_clean", "SELECT category_id, parent_id FROM clean_tree")
def _(s):
    return v.clean_category_tree(s.raw_tree)


@query(
    "category_tree_validation_stats",
    """
SELECT stat, n FROM (
  SELECT count(*) AS initial_rows, count(*) FILTER (category_id IS NULL) AS nulls_removed,
         count(*) FILTER (category_id <= 0 OR parent_id <= 0) AS invalid_ids,
         count(*) FILTER (category_id > 0 AND (parent_id IS NULL OR parent_id > 0))
           - (SELECT count(*) FROM clean_tree) AS duplicates_removed,
         (SELECT count(*) FROM clean_tree) AS final_rows
  FROM rec_tree
) UNPIVOT (n FOR stat IN (initial_rows, nulls_removed, invalid_ids, duplicates_removed, final_rows))""",
)
def _(s):
    return v.validate_category_tree(s.raw_tree)[1]
