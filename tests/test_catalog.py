import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUICK = ["events_validation_stats", "category_stats", "split_global_test", "ab_comparison_lines", "alert_minutes_by_rule"]


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 130


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_twin(spark, name):
    con = duckdb.connect()
    for table in ("part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    result = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    expected = sorted(map(str, result.fetchall()))
    got = sorted(str(tuple(r[c] for c in columns)) for r in entry.queries()[name](spark, FOLDER).collect())
    assert got == expected
