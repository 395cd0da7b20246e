"""Parquet tables under one root folder: telemetry, events, drive metrics, run history."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wheeltrace.config import (
    DRIVE_METRICS_TABLE,
    EVENTS_TABLE,
    INGESTION_TABLE,
    TELEMETRY_TABLE,
)
from wheeltrace.schemas import (
    DRIVE_METRIC_SCHEMA,
    EVENT_SCHEMA,
    INGESTION_RUN_SCHEMA,
    TELEMETRY_SCHEMA,
)


class UnsupportedFormatError(ValueError):
    """The export path has a suffix other than .csv, .parquet or .pq."""


# Runs have a key of their own beside the columns a caller sees.
_RUN_KEY = T.StructField("_run", T.StringType())


class TelemetryStore:
    """Reads and writes the tables. A table that was never written reads as empty.

    Each write of a table goes to a folder of its own, `<table>/version-<number>-<key>`. The
    newest folder that Spark marked as complete is the table, so a write that fails, or has not
    ended, leaves the table as it was, and a table may be replaced by something computed from
    it. The version before stays, for queries that still read it; older ones are removed.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        # Bounds, texts and dates of all tables are in UTC.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.root = str(root).rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _hadoop_path(self, path: str):
        """The path and its file system, whatever its scheme."""
        context = self.spark.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(context._jsc.hadoopConfiguration())

    def _versions(self, table: str) -> list[str]:
        """Folders with a complete write of a table, oldest first.

        Spark leaves `_SUCCESS` in a folder when its write has ended. A table written before
        there were versions lies in the table's folder itself.
        """
        place, files = self._hadoop_path(self.path(table))
        if not files.exists(place):
            return []
        names = sorted(entry.getPath().getName() for entry in files.listStatus(place))
        folders = [f"{self.path(table)}/{name}" for name in names if name.startswith("version-")]
        return [
            folder
            for folder in ([self.path(table)] if "_SUCCESS" in names else []) + folders
            if files.exists(self._hadoop_path(f"{folder}/_SUCCESS")[0])
        ]

    def _read(self, path: str, schema: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _current(self, table: str, schema: T.StructType) -> DataFrame:
        versions = self._versions(table)
        if not versions:
            return self.spark.createDataFrame([], schema)
        return self._read(versions[-1], schema)

    def telemetry(self) -> DataFrame:
        return self._current(TELEMETRY_TABLE, TELEMETRY_SCHEMA)

    def events(self) -> DataFrame:
        return self._current(EVENTS_TABLE, EVENT_SCHEMA)

    def drive_metrics(self) -> DataFrame:
        return self._current(DRIVE_METRICS_TABLE, DRIVE_METRIC_SCHEMA)

    def ingestion_runs(self) -> DataFrame:
        """The run history; ids differ, also those of runs that ended at the same time.

        A run stores the number after the last one it saw. Runs that saw the same one are
        counted on in the order of their time and key. One row per run, so one task is enough.
        """
        stored = T.StructType([*INGESTION_RUN_SCHEMA.fields, _RUN_KEY])
        in_order = Window.orderBy("id", "loaded_at", _RUN_KEY.name)
        place = F.row_number().over(in_order)
        ahead = F.max(F.col("id") - F.col("_place")).over(in_order)
        return (
            self._read(self.path(INGESTION_TABLE), stored)
            .withColumn("_place", place.cast("bigint"))
            .withColumn("id", F.col("_place") + ahead)
            .select(*INGESTION_RUN_SCHEMA.names)
        )

    def _replace(self, frame: DataFrame, table: str, schema: T.StructType, time: str) -> None:
        """Write a new version of a table, which then is the table.

        Rows are sorted inside each written file, without a shuffle, so that a
        drive or a time range skips most row groups.
        """
        before = self._versions(table)
        last = before[-1].rsplit("/", 1)[-1] if before else ""
        number = int(last.split("-")[1]) + 1 if last.startswith("version-") else 1
        folder = f"{self.path(table)}/version-{number:012d}-{uuid.uuid4().hex}"
        try:
            (
                frame.select(*schema.names)
                .sortWithinPartitions("drive_id", time)
                .write.parquet(folder)
            )
        except BaseException:
            self._remove(folder)
            raise
        for old in before[:-1]:
            self._remove(old)

    def _remove(self, folder: str) -> None:
        """Remove a version's folder; files of a table without versions are left alone."""
        if folder.rsplit("/", 1)[-1].startswith("version-"):
            place, files = self._hadoop_path(folder)
            files.delete(place, True)

    def write_telemetry(self, telemetry: DataFrame) -> int:
        """Replace the telemetry table; returns its row count."""
        self._replace(telemetry, TELEMETRY_TABLE, TELEMETRY_SCHEMA, "timestamp")
        return self.telemetry().count()

    def write_events(self, events: DataFrame) -> int:
        """Replace the event table; returns its row count."""
        self._replace(events, EVENTS_TABLE, EVENT_SCHEMA, "start_time")
        return self.events().count()

    def write_drive_metrics(self, metrics: DataFrame) -> int:
        """Replace the drive-metric table; returns its row count."""
        self._replace(metrics, DRIVE_METRICS_TABLE, DRIVE_METRIC_SCHEMA, "start_time")
        return self.drive_metrics().count()

    def record_run(
        self,
        files_processed: int,
        rows_ingested: int,
        rows_served: int,
        rows_dropped: int,
        duplicate_rows_removed: int,
    ) -> None:
        """Append one row to the run history; ids count up from 1 (see `ingestion_runs`)."""
        run = self.ingestion_runs().agg(
            (F.coalesce(F.max("id"), F.lit(0)) + 1).cast("bigint").alias("id"),
            *[
                F.lit(value).cast("bigint").alias(name)
                for name, value in (
                    ("files_processed", files_processed),
                    ("rows_ingested", rows_ingested),
                    ("rows_served", rows_served),
                    ("rows_dropped", rows_dropped),
                    ("duplicate_rows_removed", duplicate_rows_removed),
                )
            ],
            F.current_timestamp().alias("loaded_at"),
            F.lit(uuid.uuid4().hex).alias(_RUN_KEY.name),
        )
        run.write.mode("append").parquet(self.path(INGESTION_TABLE))


def export(frame: DataFrame, path: str) -> str:
    """Write a frame as CSV with header or as Parquet, by the path's suffix.

    The result is a folder of part files, written by all executors in parallel.
    """
    if not isinstance(frame, DataFrame):
        raise TypeError("data must be a Spark DataFrame.")
    suffix = str(path).rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()
    writer = frame.write.mode("overwrite")
    if suffix == "csv":
        # By default Spark cuts times to milliseconds.
        writer.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").option(
            "header", True
        ).option("escape", '"').csv(str(path))
    elif suffix in ("parquet", "pq"):
        writer.parquet(str(path))
    else:
        raise UnsupportedFormatError("Unsupported export format. Use .csv, .parquet, or .pq.")
    return str(path)
