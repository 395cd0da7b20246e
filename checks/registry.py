"""Every operator as a query over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.derived import (
    coerced_rows,
    raw_rows,
    store,
    stored_events,
    stored_metrics,
    stored_telemetry,
    telemetry,
)
from wheeltrace.client import (
    FleetClient,
    filter_events,
    filter_telemetry,
    first_events,
    first_telemetry,
    merge_drive_profile,
    read_only_sql,
)
from wheeltrace.functions.scalars import elapsed_seconds, is_switched_on, state_code, state_label
from wheeltrace.operators import cleaning, detection, insights, metrics, samples
from wheeltrace.operators.canonical import add_distance_delta, to_telemetry
from wheeltrace.operators.scale import checkpoint_folder, materialize
from wheeltrace.plans import ingest, reports
from wheeltrace.schemas import EVENT_SCHEMA
from wheeltrace.sources.csv_logs import read_csv_logs
from wheeltrace.sources.store import TelemetryStore

Query = Callable[[SparkSession, str], DataFrame]

LEFT_DRIVE, RIGHT_DRIVE = "drive_0", "drive_7"


def _flat(frame: DataFrame) -> DataFrame:
    """Timestamps as whole microseconds since 1970."""
    return frame.select(
        *[
            F.unix_micros(field.name).alias(f"{field.name}_us")
            if isinstance(field.dataType, T.TimestampType)
            else F.col(f"`{field.name}`")
            for field in frame.schema
        ]
    )


def split_state(spark, sf_dir):
    rows = raw_rows(spark, sf_dir)
    autopilot, road = F.col("DAS_autopilotState"), F.col("UI_roadClass")
    return rows.select(
        "_pos",
        state_label(autopilot).alias("autopilot_state"),
        state_code(autopilot).alias("autopilot_state_code"),
        state_label(road).alias("road_class"),
        state_code(road).alias("road_class_code"),
    )


def truthy_state(spark, sf_dir):
    return raw_rows(spark, sf_dir).select(
        "_pos",
        is_switched_on(F.col("ESP_driverBrakeApply")).alias("brake_applied"),
        is_switched_on(F.col("APP_environmentRainy").cast("string")).alias("rainy"),
        is_switched_on(F.col("APP_environmentSnowy").cast("string")).alias("snowy"),
    )


def elapsed(spark, sf_dir):
    seconds = elapsed_seconds(F.col("Time_Elapsed"))
    return raw_rows(spark, sf_dir).select("_pos", seconds.alias("elapsed_seconds"))


def numeric_coercion(spark, sf_dir):
    return coerced_rows(spark, sf_dir).select(
        "_pos",
        F.col("`Time (epoch)`").alias("epoch"),
        F.col("`veh_speed (kph)`").alias("speed_kph"),
        F.col("`veh_odometer (km)`").alias("odometer_km"),
        F.col("`gps_latitude (deg)`").alias("latitude"),
        F.col("`# Vehicles`").alias("vehicles"),
    )


def drop_invalid_epoch(spark, sf_dir):
    return cleaning.drop_missing_epoch(coerced_rows(spark, sf_dir)).select("drive_id", "_pos")


def dedup_keep_first(spark, sf_dir):
    rows = cleaning.drop_missing_epoch(coerced_rows(spark, sf_dir))
    return cleaning.keep_first_per_epoch(rows).select(
        "drive_id", "_pos", F.col("`veh_speed (kph)`").alias("speed_kph")
    )


def gps_clear(spark, sf_dir):
    return cleaning.clean(coerced_rows(spark, sf_dir)).select(
        "_pos",
        F.col("`gps_latitude (deg)`").alias("latitude"),
        F.col("`gps_longitude (deg)`").alias("longitude"),
        F.col("_gps_cleared").alias("cleared"),
    )


def quality_counts(spark, sf_dir):
    counts = cleaning.quality_counts(coerced_rows(spark, sf_dir))
    return counts.withColumn("warnings", F.array_join("warnings", "; "))


def distance_delta(spark, sf_dir):
    rows = add_distance_delta(cleaning.clean(coerced_rows(spark, sf_dir)))
    return rows.select(
        "drive_id", "_pos", F.bround("distance_delta_km", 6).alias("distance_delta_km")
    )


def _detector(detect: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: _flat(detect(stored_telemetry(spark, sf_dir)))


def event_ordinals(spark, sf_dir):
    events = detection.detect_events(stored_telemetry(spark, sf_dir))
    return _flat(events).select(
        "event_id",
        "event_type",
        "drive_id",
        "start_time_us",
        F.substring_index("event_id", ":", -1).cast("bigint").alias("ordinal"),
    )


def sample_intervals(spark, sf_dir):
    prepared = samples.prepare_samples(stored_telemetry(spark, sf_dir))
    return samples.drive_intervals(prepared).select(
        "drive_id", "typical_interval_s", "single_sample_counts"
    )


def duration_weights(spark, sf_dir):
    return samples.duration_weights(samples.prepare_samples(stored_telemetry(spark, sf_dir)))


def event_counts(spark, sf_dir):
    return metrics.event_counts(stored_events(spark, sf_dir))


def _drive_metrics(spark, sf_dir):
    return metrics.drive_metrics(stored_telemetry(spark, sf_dir))


def ingest_summary(spark, sf_dir):
    counts = cleaning.quality_counts(coerced_rows(spark, sf_dir))
    totals = ingest.telemetry_totals(stored_telemetry(spark, sf_dir))
    names = ["rows_ingested", "rows_served", "rows_dropped", "duplicate_rows_removed"]
    return totals.select(
        *[counts.select(name).scalar().alias(name) for name in names], "*"
    )


def telemetry_filter(spark, sf_dir):
    rows = stored_telemetry(spark, sf_dir)
    return _flat(filter_telemetry(rows, autopilot_state="ACTIVE_NOMINAL", min_speed_kph=60))


def telemetry_first_rows(spark, sf_dir):
    return _flat(first_telemetry(stored_telemetry(spark, sf_dir), 1000))


def telemetry_time_range(spark, sf_dir):
    rows = filter_telemetry(
        stored_telemetry(spark, sf_dir),
        start_time="2024-01-01T00:00:10",
        end_time="2024-01-01T01:00:30+01:00",
    )
    return _flat(rows.select("drive_id", "timestamp", "speed_kph"))


def sample_records(spark, sf_dir):
    return reports.sample_rows(stored_telemetry(spark, sf_dir)).select(
        "drive_id", "source_file", "speed_kph", "brake_applied", "timestamp"
    )


def events_filter(spark, sf_dir):
    events = stored_events(spark, sf_dir)
    return _flat(filter_events(events, event_type="sharp_steering", min_severity_score=0.5))


def events_first_rows(spark, sf_dir):
    return _flat(first_events(stored_events(spark, sf_dir), 1000))


def drive_metrics_one(spark, sf_dir):
    return _flat(stored_metrics(spark, sf_dir).where(F.col("drive_id") == RIGHT_DRIVE))


def param_sql(spark, sf_dir):
    return read_only_sql(
        spark,
        {"telemetry": stored_telemetry(spark, sf_dir)},
        """
        SELECT road_class, count(*) AS samples, max(speed_kph) AS top_speed_kph
        FROM telemetry WHERE speed_kph >= ? AND rainy = ? GROUP BY road_class
        """,
        [25.0, False],
    )


def drive_profile(spark, sf_dir):
    summary = metrics.drive_summary(stored_telemetry(spark, sf_dir))
    return _flat(merge_drive_profile(summary, stored_metrics(spark, sf_dir)))


def event_summary(spark, sf_dir):
    summary = insights.summarize_events(stored_events(spark, sf_dir))
    entries = F.transform(
        F.map_entries("event_counts"),
        lambda entry: F.concat_ws("=", entry["key"], entry["value"].cast("string")),
    )
    return summary.select(
        "total_events",
        F.array_join(entries, ",").alias("event_counts"),
        "max_severity_score",
        "most_common_event_type",
        F.col("highest_severity_event.event_id").alias("highest_severity_event_id"),
    )


def _comparison(spark, sf_dir):
    rows = stored_metrics(spark, sf_dir)
    return insights.compare_metrics(
        rows.where(F.col("drive_id") == LEFT_DRIVE), rows.where(F.col("drive_id") == RIGHT_DRIVE)
    )


def comparison_findings(spark, sf_dir):
    found = insights.comparison_findings(_comparison(spark, sf_dir), LEFT_DRIVE, RIGHT_DRIVE)
    return found.select(
        "metric_no",
        "insight.name",
        "insight.summary",
        F.col("insight.value").cast("double").alias("value"),
        "insight.severity",
    )


def notable_metrics(spark, sf_dir):
    found = insights.find_notable_metrics(stored_metrics(spark, sf_dir))
    return found.withColumn("threshold", F.bround("threshold", 6))


def event_insights(spark, sf_dir):
    summary = insights.summarize_events(stored_events(spark, sf_dir))
    return insights.event_findings(summary).select(
        "position", "insight.name", "insight.summary", "insight.severity"
    )


def busiest_drive(spark, sf_dir):
    found = insights.highest_rate_finding(stored_metrics(spark, sf_dir))
    return found.select("insight.name", "insight.summary", "insight.severity")


def _client(spark, sf_dir) -> FleetClient:
    return FleetClient(store(spark, sf_dir, "telemetry", "events", "metrics"))


def client_events(spark, sf_dir):
    """Events as the client serves them without arguments: all of them."""
    return _flat(_client(spark, sf_dir).events())


def client_projection(spark, sf_dir):
    """Two columns of a drive; the filter on the drive keeps its name in the result."""
    rows = _client(spark, sf_dir).telemetry(
        drive_id=LEFT_DRIVE, columns=["timestamp", "speed_kph"], end_time="2024-01-01T06:00:00"
    )
    return _flat(rows)


def client_metric(spark, sf_dir):
    """One metric of the fleet and one of a drive, as plain values."""
    client = _client(spark, sf_dir)
    return spark.range(1).select(
        F.lit(client.metric("total_events")).cast("bigint").alias("fleet_events"),
        F.lit(client.metric("max_speed_kph", RIGHT_DRIVE)).alias("top_speed_kph"),
    )


def client_summary(spark, sf_dir):
    return _flat(_client(spark, sf_dir).summary(RIGHT_DRIVE))


def export_events(spark, sf_dir):
    """All events, exported as CSV and read back with the types they had."""
    client = _client(spark, sf_dir)
    path = client.export_events(f"{_scratch(spark, 'export')}/events.csv")
    back = spark.read.schema(EVENT_SCHEMA).option("header", True).option("escape", '"').csv(path)
    return _flat(back)


def export_metrics(spark, sf_dir):
    """The drive metrics, exported as Parquet and read back."""
    client = _client(spark, sf_dir)
    return _flat(
        spark.read.parquet(client.export(client.metrics(), f"{_scratch(spark, 'export')}/m.parquet"))
    )


def run_history(spark, sf_dir):
    """The history after two runs with the counters of the raw rows, newest first."""
    target = TelemetryStore(spark, _scratch(spark, "history"))
    rows = coerced_rows(spark, sf_dir)
    counts = cleaning.quality_counts(rows).first()
    files = rows.select("source_file").distinct().count()
    for _ in range(2):
        target.record_run(
            files,
            counts.rows_ingested,
            counts.rows_served,
            counts.rows_dropped,
            counts.duplicate_rows_removed,
        )
    return FleetClient(target).ingestion_history().drop("loaded_at")


def fleet_event_totals(spark, sf_dir):
    """The event totals of the default fleet report, from its events and from its metrics."""
    report = reports.analyze_fleet(_client(spark, sf_dir))
    return report.select(
        F.col("summary.events.total_events").cast("bigint").alias("events"),
        F.col("summary.aggregate_metrics.total_events").cast("bigint").alias("metric_events"),
    )


def drive_report(spark, sf_dir):
    report = reports.analyze_drive(_client(spark, sf_dir), LEFT_DRIVE)
    return reports.as_json(report)


def fleet_report(spark, sf_dir):
    return reports.as_json(reports.analyze_fleet(_client(spark, sf_dir)))


def comparison_report(spark, sf_dir):
    report = reports.generate_analysis(_client(spark, sf_dir), LEFT_DRIVE, RIGHT_DRIVE)
    return reports.as_json(report)


def _scratch(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _write_logs(spark: SparkSession, sf_dir: str) -> str:
    """The raw rows as one CSV file per drive, named after it, its rows in order.

    Drives with an odd number have their columns in reverse and no road class, as logs of
    different versions do. A log is one file by definition, so one task writes a drive's. Spark's
    own writer would make a folder for every file, which then has to be moved.
    """
    rows = raw_rows(spark, sf_dir)
    names = [c for c in rows.columns if c not in ("source_file", "drive_id", "_chunk", "_pos")]
    orders = names, [name for name in names[::-1] if name != "UI_roadClass"]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    place = hadoop.Path(_scratch(spark, "logs"))
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(place)
    folder = system.makeQualified(place).toString().replace("file:/", "file:///", 1)

    def line(cells: list[Column]) -> Column:
        return F.to_csv(F.struct(*cells), {"escape": '"'})

    odd = F.regexp_extract("drive_id", r"(\d+)$", 1).cast("bigint") % 2
    ordinary, reverse = (line([F.col(f"`{name}`") for name in order]) for order in orders)
    heads = [line([F.lit(name).alias(f"_{k}") for k, name in enumerate(order)]) for order in orders]
    texts = rows.where(odd.isNotNull()).select(
        "drive_id",
        "_pos",
        F.when(odd == 0, heads[0]).otherwise(heads[1]).alias("head"),
        F.when(odd == 0, ordinary).otherwise(reverse).alias("line"),
    )
    in_order = texts.repartition("drive_id").sortWithinPartitions("drive_id", "_pos")
    written = in_order.select("drive_id", "head", "line").mapInArrow(
        _file_writer(folder), "files bigint"
    )
    written.write.format("noop").mode("overwrite").save()
    return folder


def _file_writer(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes the lines of each drive to its file, from rows that come by drive.

    A file gets its name when it is whole, so a task that runs again leaves no half of one.
    """

    def write(batches):
        system, root = pa_fs.FileSystem.from_uri(folder)
        part, files = f"{root}/{uuid.uuid4().hex}.part", 0
        drive = out = None
        for batch in batches:
            for name, head, line in zip(*(column.to_pylist() for column in batch.columns)):
                if name != drive:
                    if out:
                        out.close()
                        system.move(part, f"{root}/{drive}.csv")
                    drive, files = name, files + 1
                    out = system.open_output_stream(part, buffer_size=1 << 20)
                    out.write(f"{head}\n".encode())
                out.write(f"{line}\n".encode())
        if out:
            out.close()
            system.move(part, f"{root}/{drive}.csv")
        yield pa.RecordBatch.from_pydict({"files": [files]})

    return write


def ingest_csv(spark, sf_dir):
    """Canonical telemetry read back from logs with two kinds of header."""
    rows = read_csv_logs(spark, _write_logs(spark, sf_dir))
    cleaned = cleaning.clean(cleaning.coerce_columns(rows))
    return _flat(to_telemetry(materialize(cleaned, "clean-rows")))


def overview(spark, sf_dir):
    """Ingest the logs into a store, compute all metrics and build the overview page."""
    target = TelemetryStore(spark, _scratch(spark, "ingested"))
    result = ingest.ingest_folder(spark, _write_logs(spark, sf_dir), target)
    return reports.overview_json(reports.overview(FleetClient(target), result))


def queries() -> dict[str, Query]:
    return {
        "drive_summary": lambda s, d: _flat(metrics.drive_summary(stored_telemetry(s, d))),
        "split_state": split_state,
        "truthy_state": truthy_state,
        "elapsed_seconds": elapsed,
        "numeric_coercion": numeric_coercion,
        "drop_invalid_epoch": drop_invalid_epoch,
        "dedup_keep_first": dedup_keep_first,
        "gps_clear": gps_clear,
        "quality_counts": quality_counts,
        "distance_delta": distance_delta,
        "canonical_telemetry": lambda s, d: _flat(telemetry(s, d)),
        "hard_braking": _detector(detection.detect_hard_braking),
        "rapid_acceleration": _detector(detection.detect_rapid_acceleration),
        "sharp_steering": _detector(detection.detect_sharp_steering),
        "high_lateral_accel": _detector(detection.detect_high_lateral_acceleration),
        "all_events": _detector(detection.detect_events),
        "event_ordinals": event_ordinals,
        "sample_intervals": sample_intervals,
        "duration_weights": duration_weights,
        "event_counts": event_counts,
        "drive_metrics": lambda s, d: _flat(_drive_metrics(s, d)),
        "fleet_metrics": lambda s, d: metrics.fleet_metrics(stored_metrics(s, d)),
        "metric_summary": lambda s, d: insights.summarize_metrics(
            metrics.fleet_metrics(stored_metrics(s, d))
        ),
        "ingest_summary": ingest_summary,
        "telemetry_filter": telemetry_filter,
        "telemetry_first_rows": telemetry_first_rows,
        "telemetry_time_range": telemetry_time_range,
        "sample_records": sample_records,
        "events_filter": events_filter,
        "events_first_rows": events_first_rows,
        "drive_metrics_one": drive_metrics_one,
        "drive_names": lambda s, d: reports.drive_names(stored_metrics(s, d)),
        "param_sql": param_sql,
        "drive_profile": drive_profile,
        "event_summary": event_summary,
        "compare_drives": _comparison,
        "comparison_findings": comparison_findings,
        "trends": lambda s, d: insights.analyze_trends(stored_metrics(s, d)),
        "notable_metrics": notable_metrics,
        "event_insights": event_insights,
        "busiest_drive": busiest_drive,
        "client_events": client_events,
        "client_drives": lambda s, d: _flat(_client(s, d).drives()),
        "client_projection": client_projection,
        "client_metric": client_metric,
        "client_summary": client_summary,
        "export_events": export_events,
        "export_metrics": export_metrics,
        "run_history": run_history,
        "fleet_event_totals": fleet_event_totals,
        "drive_report": drive_report,
        "fleet_report": fleet_report,
        "comparison_report": comparison_report,
        "ingest_csv": ingest_csv,
        "overview": overview,
    }
