"""Validation and cleaning of raw source rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wheeltrace.functions.scalars import missing_to_null, to_number
from wheeltrace.schemas import (
    CHUNK,
    EPOCH,
    LINEAGE_COLUMNS,
    NUMERIC_SOURCE_COLUMNS,
    POSITION,
    REQUIRED_SOURCE_COLUMNS,
    TEXT_SOURCE_COLUMNS,
)

LATITUDE = "gps_latitude (deg)"
LONGITUDE = "gps_longitude (deg)"
GPS_CLEARED = "_gps_cleared"


def missing_source_columns(columns: list[str]) -> list[str]:
    return sorted(set(REQUIRED_SOURCE_COLUMNS) - set(columns))


def check_source_columns(columns: list[str]) -> None:
    missing = missing_source_columns(columns)
    if missing:
        raise ValueError("Telemetry data is missing required columns: " + ", ".join(missing))


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def coerce_columns(raw: DataFrame) -> DataFrame:
    """Lineage plus the known source columns: numbers as double, texts with NA as NULL."""
    types = {field.name: field.dataType for field in raw.schema}
    columns = [F.col(name) for name in LINEAGE_COLUMNS]
    for name in NUMERIC_SOURCE_COLUMNS:
        if name in types:
            columns.append(to_number(_quoted(name), types[name]).alias(name))
    for name in TEXT_SOURCE_COLUMNS:
        if name in types:
            text = _quoted(name)
            if not isinstance(types[name], T.StringType):
                text = text.cast("string")
            columns.append(missing_to_null(text).alias(name))
    return raw.select(*columns)


def drop_missing_epoch(coerced: DataFrame) -> DataFrame:
    return coerced.where(_quoted(EPOCH).isNotNull())


def keep_first_per_epoch(rows: DataFrame) -> DataFrame:
    """Of the rows of a file with the same epoch keep the first in file order.

    Spark turns `row_number() = 1` into a group limit that each map task applies
    before the shuffle, so many copies of one sample never meet in one task.
    """
    first = Window.partitionBy("source_file", _quoted(EPOCH)).orderBy(CHUNK, POSITION)
    return rows.withColumn("_copy", F.row_number().over(first)).where("_copy = 1").drop("_copy")


def clear_invalid_gps(rows: DataFrame) -> DataFrame:
    """NULL both coordinates when either is out of range; flag the rows in `_gps_cleared`."""
    outside = F.coalesce(~_quoted(LATITUDE).between(-90, 90), F.lit(False)) | F.coalesce(
        ~_quoted(LONGITUDE).between(-180, 180), F.lit(False)
    )
    return rows.withColumn(GPS_CLEARED, outside).withColumns(
        {
            LATITUDE: F.when(~F.col(GPS_CLEARED), _quoted(LATITUDE)),
            LONGITUDE: F.when(~F.col(GPS_CLEARED), _quoted(LONGITUDE)),
        }
    )


def clean(coerced: DataFrame) -> DataFrame:
    """Drop rows without an epoch, drop repeated samples, clear impossible positions."""
    return clear_invalid_gps(keep_first_per_epoch(drop_missing_epoch(coerced)))


def quality_counts(coerced: DataFrame) -> DataFrame:
    """One row of counters plus the warnings they call for."""
    check_source_columns(coerced.columns)
    zero = F.lit(0).cast("bigint")
    read = coerced.agg(
        F.count("*").alias("rows_ingested"),
        F.count_if(_quoted(EPOCH).isNull()).alias("rows_dropped"),
        zero.alias("rows_served"),
        zero.alias("gps_rows_cleared"),
    )
    kept = clean(coerced).agg(
        zero.alias("rows_ingested"),
        zero.alias("rows_dropped"),
        F.count("*").alias("rows_served"),
        F.count_if(GPS_CLEARED).alias("gps_rows_cleared"),
    )
    counts = (
        read.unionByName(kept)
        .agg(*[F.sum(name).alias(name) for name in read.columns])
        .withColumn(
            "duplicate_rows_removed",
            F.col("rows_ingested") - F.col("rows_dropped") - F.col("rows_served"),
        )
    )
    return counts.select(
        "rows_ingested",
        "rows_served",
        "rows_dropped",
        "duplicate_rows_removed",
        "gps_rows_cleared",
        quality_warnings(
            F.col("rows_dropped"), F.col("duplicate_rows_removed"), F.col("gps_rows_cleared")
        ).alias("warnings"),
    )


def quality_warnings(dropped: Column, duplicates: Column, cleared: Column) -> Column:
    """Array of warning texts, one per counter above zero."""

    def text(before: str, count: Column, after: str) -> Column:
        return F.when(count > 0, F.concat(F.lit(before), F.format_number(count, 0), F.lit(after)))

    return F.array_compact(
        F.array(
            text("Dropped ", dropped, " rows with invalid timestamps."),
            text("Removed ", duplicates, " duplicate telemetry samples."),
            text("Cleared invalid GPS coordinates in ", cleared, " rows."),
        )
    )
