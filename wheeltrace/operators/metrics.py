"""Per-drive and fleet metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wheeltrace.config import DEFAULT_RULES, EVENT_TYPES, FINE_CELL_US, SECOND_US
from wheeltrace.functions.scalars import per_100_km, percent_of
from wheeltrace.operators.detection import qualifying_runs
from wheeltrace.operators.samples import drive_intervals, prepare_samples
from wheeltrace.operators.scale import by_shuffle, materialize
from wheeltrace.schemas import DRIVE_METRIC_SCHEMA

_RATES = (*[(f"{kind}_count", f"{kind}_per_100_km") for kind in EVENT_TYPES],)


def drive_summary(telemetry: DataFrame) -> DataFrame:
    """One row per drive and file: samples, time span, distance, speeds, assisted samples.

    `autopilot_samples` counts every known state but UNAVAILABLE, engaged or not.
    Rounds half up, as SQL does; the metrics below round half to even.
    """
    state = F.col("autopilot_state")
    return telemetry.groupBy("drive_id", "source_file").agg(
        F.count("*").alias("samples"),
        F.min("timestamp").alias("start_time"),
        F.max("timestamp").alias("end_time"),
        F.round(F.sum("distance_delta_km"), 3).alias("distance_km"),
        F.round(F.avg("speed_kph"), 2).alias("average_speed_kph"),
        F.round(F.max("speed_kph"), 2).alias("max_speed_kph"),
        F.count_if(state.isNotNull() & (state != "UNAVAILABLE")).alias("autopilot_samples"),
    )


def _drive_totals(samples: DataFrame) -> DataFrame:
    """Sums and extremes per drive.

    The first step groups by file as well, so its buffers hold numbers only and
    Spark can pre-aggregate with a hash table; the text of the first file is
    picked in the second step, from one row per file.
    """
    step = F.greatest("distance_delta_km", F.lit(0.0))
    per_file = samples.groupBy("drive_id", "source_file").agg(
        F.min("moment_us").alias("start_us"),
        F.max("moment_us").alias("end_us"),
        F.sum(step).alias("distance"),
        F.sum(F.when(F.col("is_active"), step)).alias("active_distance"),
        F.sum("speed_kph").alias("speed_sum"),
        F.count("speed_kph").alias("speed_count"),
        F.max("speed_kph").alias("speed_max"),
    )
    return per_file.groupBy("drive_id").agg(
        F.min_by("source_file", F.struct("start_us", "source_file")).alias("source_file"),
        F.min("start_us").alias("start_us"),
        F.max("end_us").alias("end_us"),
        F.coalesce(F.sum("distance"), F.lit(0.0)).alias("distance"),
        F.coalesce(F.sum("active_distance"), F.lit(0.0)).alias("active_distance"),
        (F.sum("speed_sum") / F.nullif(F.sum("speed_count"), F.lit(0))).alias("speed_mean"),
        F.max("speed_max").alias("speed_max"),
    )


def event_counts(events: DataFrame) -> DataFrame:
    """Events of each known type per drive."""
    return events.groupBy("drive_id").agg(
        *[F.count_if(F.col("event_type") == kind).alias(f"{kind}_count") for kind in EVENT_TYPES]
    )


def drive_metrics(
    telemetry: DataFrame,
    events: DataFrame | None = None,
    fine_us: int = FINE_CELL_US,
    intervals: DataFrame | None = None,
) -> DataFrame:
    """One `drive_metrics` row per drive, normalised by time and distance.

    Without `events` they are detected from the telemetry. `intervals` takes a
    result of `drive_intervals` to use again. Each of the joined inputs has one
    row per drive.
    """
    samples = prepare_samples(telemetry)
    if intervals is None:
        intervals = drive_intervals(samples, fine_us)
        if events is None:
            # Needed for both detection and time; one row per drive.
            intervals = materialize(intervals, "intervals")
    if events is None:
        events = qualifying_runs(telemetry, DEFAULT_RULES, fine_us, intervals=intervals)
    rows = (
        _drive_totals(samples)
        .join(by_shuffle(intervals), "drive_id", "left")
        .join(event_counts(events), "drive_id", "left")
        .fillna(0, [count for count, _ in _RATES])
    )
    seconds = (F.col("end_us") - F.col("start_us")) / SECOND_US
    distance = F.col("distance")
    active_time = F.coalesce("active_time_s", F.lit(0.0))
    total = sum((F.col(count) for count, _ in _RATES[1:]), F.col(_RATES[0][0]))
    values = {
        "drive_id": F.col("drive_id"),
        "source_file": F.col("source_file"),
        "start_time": F.timestamp_micros("start_us"),
        "end_time": F.timestamp_micros("end_us"),
        "duration_s": F.bround(seconds, 3),
        "distance_km": F.bround(distance, 6),
        "average_speed_kph": F.bround(F.coalesce("speed_mean", F.lit(0.0)), 3),
        "max_speed_kph": F.bround(F.coalesce("speed_max", F.lit(0.0)), 3),
        "autopilot_active_time_s": F.bround(active_time, 3),
        "autopilot_active_distance_km": F.bround("active_distance", 6),
        "autopilot_active_pct": percent_of(active_time, seconds),
        "total_events": total,
        "events_per_100_km": per_100_km(total, distance),
    }
    for count, rate in _RATES:
        values[count] = F.col(count)
        values[rate] = per_100_km(F.col(count), distance)
    return rows.select(
        *[
            values[field.name].cast(field.dataType).alias(field.name)
            for field in DRIVE_METRIC_SCHEMA.fields
        ]
    )


def fleet_metrics(metrics: DataFrame) -> DataFrame:
    """One row over all drives: rates from summed counts, speed weighted by time."""
    duration = F.greatest(F.coalesce("duration_s", F.lit(0.0)), F.lit(0.0))
    speed = F.coalesce("average_speed_kph", F.lit(0.0))

    def total(name: str):
        return F.coalesce(F.sum(name), F.lit(0))

    sums = metrics.agg(
        F.count_distinct("drive_id").alias("drives"),
        total("distance_km").cast("double").alias("distance"),
        F.coalesce(F.sum(duration), F.lit(0.0)).alias("duration"),
        F.coalesce(F.sum(speed * duration), F.lit(0.0)).alias("speed_time"),
        F.coalesce(F.avg(speed), F.lit(0.0)).alias("speed_mean"),
        F.coalesce(F.max("max_speed_kph"), F.lit(0.0)).alias("speed_max"),
        total("autopilot_active_distance_km").cast("double").alias("active_distance"),
        total("autopilot_active_time_s").cast("double").alias("active_time"),
        *[total(count).cast("bigint").alias(count) for count, _ in _RATES],
    )
    distance, length = F.col("distance"), F.col("duration")
    mean_speed = F.when(length > 0, F.col("speed_time") / F.nullif(length, F.lit(0.0))).otherwise(
        F.col("speed_mean")
    )
    events = sum((F.col(count) for count, _ in _RATES[1:]), F.col(_RATES[0][0]))
    per_type = []
    for count, rate in _RATES:
        per_type += [F.col(count), per_100_km(F.col(count), distance).alias(rate)]
    return sums.select(
        "drives",
        F.bround(distance, 6).alias("distance_km"),
        F.bround(length, 3).alias("duration_s"),
        F.bround(mean_speed, 3).alias("average_speed_kph"),
        F.bround("speed_max", 3).alias("max_speed_kph"),
        F.bround("active_distance", 6).alias("autopilot_active_distance_km"),
        F.bround("active_time", 3).alias("autopilot_active_time_s"),
        percent_of(F.col("active_time"), length).alias("autopilot_active_pct"),
        *per_type,
        events.alias("total_events"),
        per_100_km(events, distance).alias("events_per_100_km"),
    )
