from conftest import values

from cartlens.operators import validation as v

EVENTS = "user_id bigint, item_id bigint, timestamp bigint, event string"
OK = 1_400_000_000_000


def stats(df):
    return {r["stat"]: r["n"] for r in df.collect()}


def test_each_row_counts_at_its_first_failure(frame):
    rows = [
        (None, 1, OK, "bad"),  # null comes before the event check
        (1, 1, OK, "refund"),
        (1, 1, 5, "view"),
        (0, 1, OK, "view"),
        (1, 0, 5, "view"),  # time comes before ids
        (1, 1, OK, "view"),
        (1, 1, OK, "view"),
        (1, 1, 1262304000000, "view"),  # both bounds are inside
        (1, 1, 1893456000000, "view"),
        (1, 1, 1893456000001, "view"),
    ]
    clean, counted = v.validate_events(frame(rows, EVENTS))
    got = stats(counted)
    assert got == {
        "initial_rows": 10,
        "nulls_removed": 1,
        "invalid_events": 1,
        "invalid_timestamps": 3,
        "invalid_ids": 1,
        "duplicates_removed": 1,
        "final_rows": 3,
    }
    assert clean.count() == 3
    assert got["initial_rows"] == sum(n for k, n in got.items() if k != "initial_rows")


def test_empty_events(frame):
    clean, counted = v.validate_events(frame([], EVENTS))
    assert clean.count() == 0
    assert set(stats(counted).values()) == {0}
    assert v.pass_percent(counted).first()["pass_pct"] == 0.0


def test_timestamps_become_millis(frame, spark):
    df = spark.sql("SELECT 1L AS user_id, 2L AS item_id, 'view' AS event, timestamp '2014-01-01 00:00:00' AS timestamp")
    assert values(v.validate_events(df)[0], "timestamp") == [(1388534400000,)]


def test_property_value_may_be_null(frame):
    rows = [(OK, 1, "p", None), (OK, None, "p", "x"), (OK, 0, "p", "x"), (1, 1, "p", "x")]
    clean, counted = v.validate_item_properties(frame(rows, "timestamp bigint, item_id bigint, property string, value string"))
    assert values(clean, "item_id", "value") == [(1, None)]
    assert stats(counted)["invalid_timestamps"] == 1


def test_tree_rules_and_optional_parent(frame):
    rows = [(1, None), (2, 1), (3, 0), (-1, 1), (None, 1), (2, 1)]
    clean, counted = v.validate_category_tree(frame(rows, "category_id bigint, parent_id bigint"))
    assert values(clean) == [(1, None), (2, 1)] or values(clean) == [(2, 1), (1, None)]
    got = stats(counted)
    assert (got["invalid_ids"], got["nulls_removed"], got["duplicates_removed"]) == (2, 1, 1)
    only_ids, _ = v.validate_category_tree(frame([(1,), (0,)], "category_id bigint"))
    assert values(only_ids) == [(1,)]
