import json

import __spark_entry__ as spark_entry
import pytest

from checks import oracle, registry
from checks.compare import connect, difference
from wheeltrace.schemas import DRIVE_METRIC_COLUMNS

SF_DIR = "/root/testdata/sf0.001"
QUERIES = registry.queries()
SQL = oracle.oracle_sql()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {
        "drive_report",
        "fleet_report",
        "comparison_report",
        "overview",
    }


def test_entry_points_hold_them():
    assert QUERIES.keys() <= spark_entry.queries().keys()
    assert spark_entry.oracle_sql().keys() <= spark_entry.queries().keys()
    assert SQL.items() <= spark_entry.oracle_sql().items()


def test_overview_counts_every_drive_and_event(spark):
    page = json.loads(QUERIES["overview"](spark, SF_DIR).first().json)
    drives = QUERIES["drive_metrics"](spark, SF_DIR).collect()
    fleet = page["fleet_analysis"]
    assert page["pipeline"]["files_processed"] == fleet["summary"]["drive_count"] == len(drives)
    total = sum(row.total_events for row in drives)
    assert fleet["summary"]["events"]["total_events"] == total
    assert fleet["summary"]["aggregate_metrics"]["total_events"] == total


def test_entry(spark):
    result = spark_entry.entry(spark)
    assert len(result.columns) == len(DRIVE_METRIC_COLUMNS)
    assert result.count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    result = QUERIES[name](spark, SF_DIR).toPandas()
    if name in SQL:
        assert difference(result, connect(SF_DIR).sql(SQL[name]).df()) is None
    else:
        assert len(result) == 1
