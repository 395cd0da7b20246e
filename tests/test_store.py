"""Versions of the store's tables, ids of runs, and names of a query's tables."""

import pytest
from pyspark.errors import ParseException
from pyspark.sql import functions as F

from wheeltrace.client import FleetClient, read_only_sql
from wheeltrace.config import INGESTION_TABLE
from wheeltrace.schemas import INGESTION_RUN_SCHEMA, TELEMETRY_SCHEMA
from wheeltrace.sources.store import TelemetryStore


def rows(spark, *speeds):
    names = [field.name for field in TELEMETRY_SCHEMA.fields]
    known = {"drive_id": F.lit("a"), "speed_kph": F.col("speed_kph")}
    frame = spark.createDataFrame([(float(v),) for v in speeds], "speed_kph double")
    return frame.select(
        *[
            known.get(name, F.lit(None)).cast(TELEMETRY_SCHEMA[name].dataType).alias(name)
            for name in names
        ]
    )


def speeds(frame):
    return sorted(row.speed_kph for row in frame.collect())


def failing(spark):
    broken = F.when(F.col("speed_kph") > 1, F.raise_error(F.lit("broken"))).otherwise(0.0)
    return rows(spark, 1, 2, 3).withColumn("speed_kph", broken.cast("double"))


def test_a_failed_write_leaves_the_table(spark, tmp_path):
    store = TelemetryStore(spark, tmp_path)
    with pytest.raises(Exception, match="broken"):
        store.write_telemetry(failing(spark))
    assert store.telemetry().count() == 0
    assert store.write_telemetry(rows(spark, 5, 6)) == 2
    with pytest.raises(Exception, match="broken"):
        store.write_telemetry(failing(spark))
    assert speeds(store.telemetry()) == [5, 6]
    assert len(list((tmp_path / "telemetry").glob("version-*"))) == 1


def test_a_write_that_has_not_ended_is_not_read(spark, tmp_path):
    store = TelemetryStore(spark, tmp_path)
    store.write_telemetry(rows(spark, 5))
    store.write_telemetry(rows(spark, 7))
    newest = sorted((tmp_path / "telemetry").glob("version-*"))[-1]
    (newest / "_SUCCESS").unlink()
    assert speeds(store.telemetry()) == [5]


def test_a_table_replaced_by_itself_and_read_meanwhile(spark, tmp_path):
    store = TelemetryStore(spark, tmp_path)
    store.write_telemetry(rows(spark, 1, 2, 3))
    before = store.telemetry()
    assert store.write_telemetry(before.where("speed_kph > 1")) == 2
    assert speeds(before) == [1, 2, 3]
    store.write_telemetry(store.telemetry().where("speed_kph > 2"))
    assert speeds(store.telemetry()) == [3]
    names = sorted(path.name[:20] for path in (tmp_path / "telemetry").iterdir())
    assert names == ["version-000000000002", "version-000000000003"]


def test_a_table_without_versions_is_read_until_it_is_replaced(spark, tmp_path):
    rows(spark, 4).write.parquet(str(tmp_path / "telemetry"))
    store = TelemetryStore(spark, tmp_path)
    assert speeds(store.telemetry()) == [4]
    store.write_telemetry(rows(spark, 9))
    assert speeds(store.telemetry()) == [9]


def test_runs_count_up_and_differ_when_they_end_at_once(spark, tmp_path):
    store = TelemetryStore(spark, tmp_path)
    for n in range(2):
        store.record_run(n, 0, 0, 0, 0)
    # A run that saw the same history as the second one, and one before there were keys.
    stored = spark.read.parquet(store.path(INGESTION_TABLE))
    twin = stored.where("files_processed = 1").withColumn("files_processed", F.lit(7).cast("bigint"))
    twin = spark.createDataFrame(twin.collect(), twin.schema).drop("_run")
    twin.write.mode("append").parquet(store.path(INGESTION_TABLE))
    store.record_run(3, 0, 0, 0, 0)
    history = FleetClient(store).ingestion_history().collect()
    assert [row.id for row in history] == [4, 3, 2, 1]
    assert history[0].files_processed == 3 and history[-1].files_processed == 0
    assert store.ingestion_runs().columns == INGESTION_RUN_SCHEMA.names


def test_ids_go_on_after_old_runs_are_deleted(spark, tmp_path):
    store = TelemetryStore(spark, tmp_path)
    for n in range(3):
        store.record_run(n, 0, 0, 0, 0)
    kept = spark.read.parquet(store.path(INGESTION_TABLE)).where("id = 3")
    kept = spark.createDataFrame(kept.collect(), kept.schema)
    kept.write.mode("overwrite").parquet(store.path(INGESTION_TABLE))
    store.record_run(9, 0, 0, 0, 0)
    runs = store.ingestion_runs().orderBy("id").collect()
    assert [(row.id, row.files_processed) for row in runs] == [(3, 2), (4, 9)]


def test_a_query_leaves_views_of_the_session_alone(spark):
    spark.range(3).createOrReplaceTempView("telemetry")
    tables = {"telemetry": spark.range(10).select(F.col("id").alias("speed"))}
    try:
        before = {view.name for view in spark.catalog.listTables()}
        got = read_only_sql(
            spark, tables, "SELECT speed FROM telemetry t WHERE speed > ? ORDER BY speed DESC;", [6]
        )
        assert [row.speed for row in got.collect()] == [9, 8, 7]
        own = "WITH telemetry AS (SELECT 1 AS x), y AS (SELECT x + 1 AS z FROM telemetry) SELECT * FROM y"
        assert read_only_sql(spark, tables, own).first().z == 2
        assert read_only_sql(spark, {}, "SELECT ? AS x -- note", [5]).first().x == 5
        for text in ("SELECT 1) INSERT INTO x (SELECT 2", "WITH x AS (SELECT 1) INSERT INTO t TABLE x"):
            with pytest.raises(ParseException):
                read_only_sql(spark, tables, text)
        assert {view.name for view in spark.catalog.listTables()} == before
        assert spark.table("telemetry").count() == 3
    finally:
        spark.catalog.dropTempView("telemetry")
