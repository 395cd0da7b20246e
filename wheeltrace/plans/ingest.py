"""The ingest job (folder of CSV logs to telemetry table) and the metrics job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wheeltrace.functions.scalars import iso_text
from wheeltrace.operators.canonical import to_telemetry
from wheeltrace.operators.cleaning import (
    GPS_CLEARED,
    check_source_columns,
    clean,
    coerce_columns,
    missing_source_columns,
    quality_warnings,
)
from wheeltrace.operators.detection import detect_events
from wheeltrace.operators.metrics import drive_metrics, fleet_metrics
from wheeltrace.operators.samples import drive_intervals, prepare_samples
from wheeltrace.operators.scale import materialize
from wheeltrace.schemas import EPOCH, TELEMETRY_SCHEMA
from wheeltrace.sources.csv_logs import discover_csv_files, read_csv_logs
from wheeltrace.sources.store import TelemetryStore


@dataclass(frozen=True)
class IngestResult:
    """The telemetry table of a run, the files it read, and the run's counters."""

    telemetry: DataFrame
    files: DataFrame
    files_processed: int
    rows_ingested: int
    rows_served: int
    rows_dropped: int
    duplicate_rows_removed: int
    warnings: tuple[str, ...]


@dataclass(frozen=True)
class MetricsResult:
    """Events, drive metrics and the one-row fleet metrics."""

    events: DataFrame
    drive_metrics: DataFrame
    fleet_metrics: DataFrame


def ingest_folder(spark: SparkSession, data_dir: str, store: TelemetryStore) -> IngestResult:
    """Read, clean and store all logs of a folder, and record the run.

    The text is read once, by position, into the shared checkpoint folder, which fixes each
    row's place in its file. Rows then cross the network once, to drop repeated samples; the
    counters of that step are observed by the write that follows it. Its tasks end the job, so
    a task that runs again after a lost executor is not counted twice.
    """
    # Written, as a listed folder is held in the driver as long as its frame.
    files = materialize(discover_csv_files(spark, data_dir), "files")
    files_processed = files.count()
    if not files_processed:
        empty = spark.createDataFrame([], TELEMETRY_SCHEMA)
        warning = f"No CSV files found in {data_dir}."
        return IngestResult(empty, files, 0, 0, 0, 0, 0, (warning,))

    raw = read_csv_logs(spark, data_dir, files)
    if missing_source_columns(raw.columns) and raw.isEmpty():
        telemetry = spark.createDataFrame([], TELEMETRY_SCHEMA)
        ingested = dropped = duplicates = 0
        warnings = ()
    else:
        check_source_columns(raw.columns)
        coerced = coerce_columns(raw)
        read = coerced.agg(
            F.count("*").alias("rows"), F.count_if(F.col(f"`{EPOCH}`").isNull()).alias("dropped")
        ).first()
        kept = Observation()
        cleaned = clean(coerced).observe(
            kept, F.count(F.lit(1)).alias("rows"), F.count_if(GPS_CLEARED).alias("cleared")
        )
        # Written, as odometer steps look at the cleaned rows from two sides.
        telemetry = to_telemetry(materialize(cleaned, "clean-rows"))
        ingested, dropped = read.rows, read.dropped
        duplicates = ingested - dropped - kept.get["rows"]
        texts = quality_warnings(*[F.lit(n) for n in (dropped, duplicates, kept.get["cleared"])])
        warnings = tuple(spark.range(1).select(texts.alias("texts")).first().texts)

    served = store.write_telemetry(telemetry)
    store.record_run(files_processed, ingested, served, dropped, duplicates)
    return IngestResult(
        store.telemetry(),
        files,
        files_processed,
        ingested,
        served,
        dropped,
        duplicates,
        warnings,
    )


def telemetry_totals(telemetry: DataFrame) -> DataFrame:
    """One row: time span, duration, distance, speeds and drives of a telemetry table."""
    seconds = (F.unix_micros("end") - F.unix_micros("start")) / 1e6
    return telemetry.agg(
        F.min("timestamp").alias("start"),
        F.max("timestamp").alias("end"),
        F.sum("distance_delta_km").alias("distance"),
        F.avg("speed_kph").alias("speed"),
        F.max("speed_kph").alias("top_speed"),
        F.count_distinct("drive_id").alias("drives"),
    ).select(
        iso_text(F.col("start")).alias("time_start"),
        iso_text(F.col("end")).alias("time_end"),
        F.coalesce(F.bround(seconds / 60, 2), F.lit(0.0)).alias("duration_minutes"),
        F.coalesce(F.bround("distance", 3), F.lit(0.0)).alias("distance_km"),
        F.coalesce(F.bround("speed", 2), F.lit(0.0)).alias("average_speed_kph"),
        F.coalesce(F.bround("top_speed", 2), F.lit(0.0)).alias("max_speed_kph"),
        "drives",
    )


def summarize_ingest(result: IngestResult) -> DataFrame:
    """One row: the run's counters and warnings next to the telemetry totals."""
    counters = {
        "files_processed": result.files_processed,
        "rows_ingested": result.rows_ingested,
        "rows_served": result.rows_served,
        "rows_dropped": result.rows_dropped,
        "duplicate_rows_removed": result.duplicate_rows_removed,
    }
    warnings = F.array(*[F.lit(text) for text in result.warnings]).cast("array<string>")
    return telemetry_totals(result.telemetry).select(
        *[F.lit(value).cast("bigint").alias(name) for name, value in counters.items()],
        warnings.alias("warnings"),
        "*",
    )


def compute_metrics(
    store: TelemetryStore,
    telemetry: DataFrame | None = None,
    persist: bool = True,
    combine_copies: bool = True,
) -> MetricsResult:
    """Events, drive metrics and fleet metrics of a telemetry table.

    Reads the store's telemetry unless given a frame. `combine_copies=False` saves two shuffles
    where a drive has few samples of one instant, as in what the ingest job stores. With `persist`
    the tables are written, and the result reads the written tables.
    """
    source = store.telemetry() if telemetry is None else telemetry
    # One row per drive, used by both steps.
    intervals = materialize(
        drive_intervals(prepare_samples(source), combine_copies=combine_copies),
        "intervals",
    )
    events = detect_events(source, intervals=intervals, combine_copies=combine_copies)
    if persist:
        # Metrics count the written events instead of detecting them again.
        store.write_events(events)
        events = store.events()
        store.write_drive_metrics(drive_metrics(source, events, intervals=intervals))
        metrics = store.drive_metrics()
    else:
        metrics = drive_metrics(source, events, intervals=intervals)
    return MetricsResult(events, metrics, fleet_metrics(metrics))
