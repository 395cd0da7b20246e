"""Summaries, comparisons, trends and unusual drives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wheeltrace.functions.scalars import finite, iso_text, number_text, to_number
from wheeltrace.operators.scale import grouped_join, materialize, running_total
from wheeltrace.schemas import EVENT_SCHEMA

# Event rates that trends are reported for.
EVENT_RATE_COLUMNS = (
    "hard_braking_per_100_km",
    "rapid_acceleration_per_100_km",
    "sharp_steering_per_100_km",
    "high_lateral_accel_per_100_km",
    "events_per_100_km",
)

# Metrics checked for unusual drives.
NOTABLE_METRICS = (
    "events_per_100_km",
    "hard_braking_per_100_km",
    "rapid_acceleration_per_100_km",
    "sharp_steering_per_100_km",
    "high_lateral_accel_per_100_km",
    "max_speed_kph",
)

# Metrics where a low value is the unusual one.
LOW_IS_NOTABLE = ("autopilot_active_pct",)

# Keys of a compact metric summary, in order.
SUMMARY_COLUMNS = (
    "drive_id",
    "drives",
    "duration_s",
    "distance_km",
    "average_speed_kph",
    "max_speed_kph",
    "autopilot_active_time_s",
    "autopilot_active_distance_km",
    "autopilot_active_pct",
    "hard_braking_count",
    "hard_braking_per_100_km",
    "rapid_acceleration_count",
    "rapid_acceleration_per_100_km",
    "sharp_steering_count",
    "sharp_steering_per_100_km",
    "high_lateral_accel_count",
    "high_lateral_accel_per_100_km",
    "total_events",
    "events_per_100_km",
)

_MIN_POPULATION = 3


def numeric_columns(frame: DataFrame) -> list[str]:
    """Number columns in schema order, without the drive's name."""
    return [
        field.name
        for field in frame.schema
        if isinstance(field.dataType, T.NumericType) and field.name != "drive_id"
    ]


def summarize_metrics(metrics: DataFrame) -> DataFrame:
    """The summary columns of a frame of one row; no row stays no row."""
    if len(metrics.take(2)) > 1:
        raise ValueError("summarize_metrics expects exactly one metric row.")
    return metrics.select(*[name for name in SUMMARY_COLUMNS if name in metrics.columns])


def _long_form(metrics: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per input row and metric: `metric_no`, `metric`, `value` (finite or NULL)."""
    types = {field.name: field.dataType for field in metrics.schema}
    entries = [
        F.struct(
            F.lit(number).alias("metric_no"),
            F.lit(name).alias("metric"),
            to_number(F.col(name), types[name]).alias("value"),
        )
        for number, name in enumerate(names)
        if name in types
    ]
    if not entries:
        entries = [F.lit(None).cast("struct<metric_no:int,metric:string,value:double>")]
    return metrics.select(*keep, F.inline(F.array_compact(F.array(*entries))))


def percent_change(change: Column, base: Column) -> Column:
    return change / F.nullif(F.abs(base), F.lit(0.0)) * 100.0


def compare_metrics(
    left: DataFrame, right: DataFrame, metric_names: Sequence[str] | None = None
) -> DataFrame:
    """Two one-row frames compared metric by metric, left to right.

    Only metrics with a number on both sides appear. The percentage is NULL when
    the left value is zero. Without names all shared numeric columns are compared,
    in the order of the left frame (`metric_no`).
    """
    if metric_names is None:
        shared = set(numeric_columns(right))
        metric_names = [name for name in numeric_columns(left) if name in shared]
    ours = _long_form(left, metric_names).where("value IS NOT NULL")
    theirs = _long_form(right, metric_names).where("value IS NOT NULL")
    difference = F.col("right_value") - F.col("left_value")
    return (
        ours.withColumnRenamed("value", "left_value")
        .join(
            theirs.select("metric_no", F.col("value").alias("right_value")),
            "metric_no",
        )
        .select(
            "metric_no",
            "metric",
            "left_value",
            "right_value",
            difference.alias("difference"),
            percent_change(difference, F.col("left_value")).alias("pct_difference"),
        )
    )


def analyze_trends(
    metrics: DataFrame,
    metric_names: Sequence[str] | None = None,
    order_by: str = "start_time",
) -> DataFrame:
    """First-to-last change of each metric over drives in time order.

    A single aggregation; drives that start together are ordered by `drive_id`.
    Rows without a readable time count as last. Metrics need two values.
    """
    names = numeric_columns(metrics) if metric_names is None else metric_names
    tie = F.col("drive_id") if "drive_id" in metrics.columns else F.lit("")
    if order_by in metrics.columns:
        moment = F.col(order_by).try_cast("timestamp")
    else:
        moment = F.lit(None).cast("timestamp")
    position = F.struct(moment.isNull().alias("untimed"), moment.alias("moment"), tie.alias("tie"))
    long = _long_form(
        metrics.withColumn("_position", position), names, ["_position"]
    ).where("value IS NOT NULL")
    first, last = F.col("first_value"), F.col("last_value")
    change = last - first
    tolerance = F.greatest(F.abs(first), F.abs(last), F.lit(1.0)) * 1e-9
    direction = (
        F.when(F.abs(change) <= tolerance, "stable")
        .when(change > 0, "increasing")
        .otherwise("decreasing")
    )
    return (
        long.groupBy("metric_no", "metric")
        .agg(
            F.min_by("value", "_position").alias("first_value"),
            F.max_by("value", "_position").alias("last_value"),
            F.count("*").alias("_values"),
        )
        .where("_values >= 2")
        .select(
            "metric_no",
            "metric",
            "first_value",
            "last_value",
            change.alias("absolute_change"),
            percent_change(change, first).alias("change_pct"),
            direction.alias("direction"),
        )
    )


def _percentile_thresholds(ranked: DataFrame, percentile: float) -> DataFrame:
    """Exact interpolated percentile per metric from cumulative counts.

    `ranked` holds the distinct values of a metric with `upto`, the number of
    drives at or below each; one row per metric comes out.
    """
    low = F.col("metric").isin(*LOW_IS_NOTABLE)
    share = F.when(low, F.lit(1.0 - percentile)).otherwise(F.lit(percentile))
    # The population size is the cumulative count of the largest value.
    sizes = (
        ranked.groupBy("metric")
        .agg(F.max("upto").alias("population"))
        .where(F.col("population") >= _MIN_POPULATION)
        .withColumn("_at", (F.col("population") - 1) * share)
        .withColumn("_low_at", F.floor("_at"))
    )
    return (
        # One row per metric, so small by construction.
        ranked.join(F.broadcast(sizes), "metric")
        .groupBy("metric", "population", "_at", "_low_at")
        .agg(
            F.min(F.when(F.col("upto") > F.col("_low_at"), F.col("value"))).alias("_lower"),
            F.min(F.when(F.col("upto") > F.ceil("_at"), F.col("value"))).alias("_upper"),
        )
        .select(
            "metric",
            "population",
            (
                F.col("_lower")
                + (F.col("_upper") - F.col("_lower")) * (F.col("_at") - F.col("_low_at"))
            ).alias("threshold"),
        )
    )


def find_notable_metrics(
    metrics: DataFrame,
    drive_id: str | None = None,
    metric_names: Sequence[str] = NOTABLE_METRICS,
    percentile: float = 0.95,
) -> DataFrame:
    """Metrics in which a drive is extreme among all drives.

    Covers every drive, or one if named. Ranks come from cumulative counts of
    distinct values, computed in slices and written once, so no task holds all drives
    of a metric. Drives are compared with the threshold first; only notable ones look
    up their rank, and a value that many drives share is spread over all tasks.
    """
    if not 0.5 < percentile < 1.0:
        raise ValueError("percentile must be greater than 0.5 and less than 1.0.")
    long = _long_form(metrics, metric_names, ["drive_id"]).where("value IS NOT NULL")
    counted = long.groupBy("metric", "value").agg(F.count("*").alias("_drives"))
    ranked = materialize(
        running_total(counted, ["metric"], ["value"], F.col("_drives"), "upto"), "ranked"
    )
    # One row per metric.
    thresholds = F.broadcast(_percentile_thresholds(ranked, percentile))

    low = F.col("metric").isin(*LOW_IS_NOTABLE)
    value, threshold = F.col("value"), F.col("threshold")
    notable = F.when(low, value <= threshold).otherwise(value >= threshold)
    drives = long if drive_id is None else long.where(F.col("drive_id") == drive_id)
    unusual = materialize(
        drives.join(thresholds, "metric").where(notable).drop("population"), "unusual"
    )
    ranks = (
        ranked.join(thresholds, "metric")
        .where(notable)
        .select(
            "metric",
            "value",
            "_drives",
            (F.col("upto") / F.col("population") * 100.0).alias("_rank"),
        )
    )
    total = ranked.agg(F.sum("_drives")).first()[0] or 0
    found = grouped_join(unusual, ranks, ["metric", "value"], "_drives", total)
    rank = F.col("_rank")
    return found.select(
        "drive_id",
        "metric_no",
        "metric",
        "value",
        "threshold",
        F.bround(rank, 2).alias("percentile_rank"),
        F.when(low, "low").otherwise("high").alias("direction"),
        F.when((rank >= 99.0) | (rank <= 1.0), "high").otherwise("medium").alias("severity"),
        F.lit(percentile).alias("comparison_percentile"),
    )


def summarize_events(events: DataFrame) -> DataFrame:
    """One row: totals, counts per type, most common type, most severe event.

    The most common type comes first in `event_counts`; on equal counts the type
    seen first wins, and so does the earliest of equally severe events.
    """
    names = [name for name in EVENT_SCHEMA.names if name in events.columns]
    severity = finite(F.col("severity_score"))
    order = F.when(severity.isNotNull(), F.struct(-severity, "start_time", "event_id"))
    per_type = events.groupBy("event_type").agg(
        F.count("*").alias("events"),
        F.min(F.struct("start_time", "event_id")).alias("first"),
        F.min(order).alias("order"),
        F.min_by(F.struct(*names), order).alias("event"),
    )
    # From here on one row per event type.
    counts = F.array_sort(
        F.collect_list(F.struct((-F.col("events")).alias("rank"), "first", "event_type", "events"))
    )
    return per_type.agg(
        F.coalesce(F.sum("events"), F.lit(0)).cast("bigint").alias("total_events"),
        counts.alias("_counts"),
        F.min_by("event", "order").alias("highest_severity_event"),
    ).select(
        "total_events",
        F.map_from_entries(
            F.transform(
                F.filter("_counts", lambda c: c["event_type"].isNotNull()),
                lambda c: F.struct(c["event_type"], c["events"]),
            )
        ).alias("event_counts"),
        F.coalesce("highest_severity_event.severity_score", F.lit(0.0)).alias(
            "max_severity_score"
        ),
        F.try_element_at("_counts", F.lit(1))["event_type"].alias("most_common_event_type"),
        "highest_severity_event",
    )


def insight(
    name: str | Column,
    summary: Column,
    value: Column,
    severity: str | Column = "info",
    metadata: Column | None = None,
) -> Column:
    """One finding. Value and metadata are variants because their shape differs by finding."""
    details = F.parse_json(F.lit("{}")) if metadata is None else F.to_variant_object(metadata)
    return F.struct(
        (F.lit(name) if isinstance(name, str) else name).alias("name"),
        summary.alias("summary"),
        value.cast("variant").alias("value"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        details.alias("metadata"),
    )


def event_findings(summary: DataFrame) -> DataFrame:
    """Findings about events from `summarize_events`: `position` and `insight`."""
    total, common = F.col("total_events"), F.col("most_common_event_type")
    count = F.coalesce(F.try_element_at("event_counts", common), F.lit(0).cast("bigint"))
    worst = F.col("highest_severity_event")
    timed = worst
    for name in ("start_time", "end_time"):
        timed = timed.withField(name, iso_text(worst[name]))
    none_found = insight(
        "no_detected_events",
        F.lit("No configured driving events were detected for this scope."),
        F.lit(0),
    )
    most_common = insight(
        "most_common_event",
        F.concat(common, F.lit(" was the most common detected event ("), count, F.lit(").")),
        count,
        metadata=F.struct(common.alias("event_type")),
    )
    most_severe = insight(
        "highest_severity_event",
        F.concat(
            F.lit("The highest-severity event was "),
            worst["event_type"],
            F.lit(" with severity "),
            number_text(worst["severity_score"]),
            F.lit("."),
        ),
        worst["severity_score"],
        "high",
        timed,
    )
    findings = F.array_compact(
        F.array(
            F.when(total == 0, none_found),
            F.when(total > 0, most_common),
            F.when((total > 0) & worst.isNotNull(), most_severe),
        )
    )
    return summary.select(F.posexplode(findings).alias("position", "insight"))


def notable_findings(notable: DataFrame) -> DataFrame:
    """Findings from `find_notable_metrics`: `drive_id`, `metric_no` and `insight`."""
    text = F.concat(
        F.col("metric"),
        F.lit(" is unusually "),
        F.col("direction"),
        F.lit(" at "),
        number_text(F.col("value")),
        F.lit(", relative to the analyzed drives."),
    )
    details = F.struct("metric", "threshold", "percentile_rank", "comparison_percentile")
    return notable.select(
        "drive_id",
        "metric_no",
        insight(
            F.concat(F.lit("notable_"), F.col("metric")),
            text,
            F.col("value"),
            F.col("severity"),
            details,
        ).alias("insight"),
    )


def comparison_findings(
    comparison: DataFrame, left_drive_id: str, right_drive_id: str
) -> DataFrame:
    """Findings for metrics that differ by 10 percent or more: `metric_no` and `insight`."""
    pct = F.col("pct_difference")
    size = F.abs(pct)
    text = F.concat(
        F.col("metric"),
        F.lit(" was "),
        number_text(size, 1),
        F.lit("% "),
        F.when(F.col("difference") > 0, "higher").otherwise("lower"),
        F.lit(f" in {right_drive_id} than {left_drive_id}."),
    )
    details = F.struct(
        "metric",
        F.lit(left_drive_id).alias("left_drive_id"),
        F.lit(right_drive_id).alias("right_drive_id"),
    )
    return comparison.where(size >= 10.0).select(
        "metric_no",
        insight(
            F.concat(F.lit("comparison_"), F.col("metric")),
            text,
            pct,
            F.when(size < 50.0, "medium").otherwise("high"),
            details,
        ).alias("insight"),
    )


def highest_rate_finding(metrics: DataFrame) -> DataFrame:
    """Finding on the drive with the highest event rate; the earliest drive on a tie."""
    rate = finite(F.col("events_per_100_km"))
    rated = F.when(rate.isNotNull(), F.struct(-rate, "start_time", "drive_id"))
    top = metrics.agg(
        F.min_by("drive_id", rated).alias("drive_id"),
        F.min_by("events_per_100_km", rated).alias("rate"),
    ).where("rate IS NOT NULL")
    text = F.concat(
        F.lit("Drive "),
        F.col("drive_id"),
        F.lit(" had the highest detected-event rate at "),
        number_text(F.col("rate")),
        F.lit(" per 100 km."),
    )
    return top.select(
        insight(
            "highest_event_rate_drive",
            text,
            F.col("rate"),
            "medium",
            F.struct("drive_id"),
        ).alias("insight")
    )
