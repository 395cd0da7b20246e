"""Reports: one row with title, scope, summary, insights and metadata.

Everything in a report is bounded: one drive's or the fleet's totals, one entry
per metric or event type. Parts are joined as scalar subqueries.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wheeltrace.client import (
    FleetClient,
    first_telemetry,
)
from wheeltrace.functions.scalars import finite, iso_text, number_text
from wheeltrace.operators.insights import (
    EVENT_RATE_COLUMNS,
    SUMMARY_COLUMNS,
    analyze_trends,
    compare_metrics,
    comparison_findings,
    event_findings,
    find_notable_metrics,
    highest_rate_finding,
    insight,
    notable_findings,
    summarize_events,
)
from wheeltrace.operators.metrics import fleet_metrics
from wheeltrace.operators.scale import materialize
from wheeltrace.plans.ingest import IngestResult, compute_metrics, summarize_ingest

SAMPLE_ROWS = 100

_JSON = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'",
}


def _cell(one_row: DataFrame, value: Column) -> Column:
    """A value of a one-row frame, for use in another frame."""
    return one_row.select(value.alias("_cell")).scalar()


def _ordered(rows: DataFrame, order: str, value: Column) -> Column:
    """The few rows of a bounded frame as an array in order."""
    pairs = F.collect_list(F.struct(F.col(order).alias("at"), value.alias("value")))
    in_order = F.array_sort(pairs, lambda a, b: a["at"] - b["at"])
    return rows.select(F.transform(in_order, lambda pair: pair["value"]).alias("_cell")).scalar()


def _report(
    base: DataFrame,
    title: str,
    scope: str,
    summary: Column,
    insights: Sequence[Column],
    metadata: Column,
) -> DataFrame:
    return base.select(
        F.lit(title).alias("title"),
        F.lit(scope).alias("scope"),
        summary.alias("summary"),
        F.concat(*insights).alias("insights"),
        metadata.alias("metadata"),
    )


def _row(frame: DataFrame) -> Column:
    return F.struct(*[F.col(name) for name in frame.columns])


def _written_summary(events: DataFrame) -> DataFrame:
    """The one-row event summary, written: cells, findings and counts of a report read it.

    Scalar subqueries of one plan would each scan the events again.
    """
    return materialize(summarize_events(events), "event-summary")


def drive_report(
    profile: DataFrame,
    events: DataFrame,
    metrics: DataFrame,
    drive_id: str,
    percentile: float = 0.95,
) -> DataFrame:
    """Report on one drive: its event rate, unusual metrics and event findings.

    `profile` is the drive's summary row, `events` its events, `metrics` those of
    all drives.
    """
    own = metrics.where(F.col("drive_id") == drive_id)
    compact = own.select(*[name for name in SUMMARY_COLUMNS if name in own.columns])
    events_row = _written_summary(events)
    notable = notable_findings(find_notable_metrics(metrics, drive_id, percentile=percentile))
    rate = finite(F.col("events_per_100_km"))
    rate_text = F.concat(
        F.lit("The drive recorded "),
        number_text(rate),
        F.lit(" detected events per 100 km."),
    )
    rate_findings = F.array_compact(
        F.array(F.when(rate.isNotNull(), insight("event_rate", rate_text, rate)))
    )
    summary = F.struct(
        *[F.col(name) for name in profile.columns],
        _cell(compact, _row(compact)).alias("metrics"),
        _cell(events_row, _row(events_row)).alias("events"),
    )
    return _report(
        profile,
        f"Drive Analysis: {drive_id}",
        "drive",
        summary,
        [
            _cell(own, rate_findings),
            _ordered(notable, "metric_no", F.col("insight")),
            _ordered(event_findings(events_row), "position", F.col("insight")),
        ],
        F.struct(
            F.lit(drive_id).alias("drive_id"),
            F.lit(percentile).alias("comparison_percentile"),
        ),
    )


def fleet_report(telemetry: DataFrame, events: DataFrame, metrics: DataFrame) -> DataFrame:
    """Report on the fleet: totals, events, trends of event rates, the busiest drive."""
    fleet = fleet_metrics(metrics)
    totals = fleet.select(*[name for name in SUMMARY_COLUMNS if name in fleet.columns])
    events_row = _written_summary(events)
    trends = analyze_trends(
        metrics, [name for name in EVENT_RATE_COLUMNS if name in metrics.columns]
    )
    drives = telemetry.select("drive_id", "source_file").distinct().agg(F.count("*").alias("n"))
    top = highest_rate_finding(metrics)
    trend = F.struct(*[F.col(name) for name in trends.columns if name != "metric_no"])
    summary = F.struct(
        _cell(drives, F.col("n")).alias("drive_count"),
        _row(totals).alias("aggregate_metrics"),
        _cell(events_row, _row(events_row)).alias("events"),
        _ordered(trends, "metric_no", trend).alias("trends"),
    )
    return _report(
        totals,
        "Fleet Analysis",
        "fleet",
        summary,
        [
            top.select(F.collect_list("insight").alias("_cell")).scalar(),
            _ordered(event_findings(events_row), "position", F.col("insight")),
        ],
        F.struct(
            _cell(metrics.agg(F.count("*").alias("n")), F.col("n")).alias("metric_rows"),
            _cell(events_row, F.col("total_events")).alias("event_rows"),
        ),
    )


def comparison_report(
    left: DataFrame,
    right: DataFrame,
    left_drive_id: str,
    right_drive_id: str,
    metric_names: Sequence[str] | None = None,
) -> DataFrame:
    """Report on two drives from their metric rows, with findings from 10 percent on."""
    comparison = compare_metrics(left, right, metric_names)
    findings = comparison_findings(comparison, left_drive_id, right_drive_id)
    entry = F.struct(*[F.col(name) for name in comparison.columns if name != "metric_no"])
    size = comparison.agg(F.count("*").alias("comparison_count"))
    summary = F.struct(
        F.lit(left_drive_id).alias("left_drive_id"),
        F.lit(right_drive_id).alias("right_drive_id"),
        _ordered(comparison, "metric_no", entry).alias("metrics"),
    )
    return _report(
        size,
        f"Drive Comparison: {left_drive_id} vs {right_drive_id}",
        "comparison",
        summary,
        [_ordered(findings, "metric_no", F.col("insight"))],
        F.struct("comparison_count"),
    )


def analyze_drive(
    client: FleetClient,
    drive_id: str,
    percentile: float = 0.95,
    event_limit: int | None = None,
) -> DataFrame:
    """Drive report from the store. All events count, or the first `event_limit`."""
    profile = client.summary(drive_id)
    events = client.events(drive_id=drive_id, limit=event_limit)
    return drive_report(profile, events, client.metrics(), drive_id, percentile)


def analyze_fleet(client: FleetClient, event_limit: int | None = None) -> DataFrame:
    """Fleet report from the store. All events count, or the first `event_limit`."""
    events = client.events(limit=event_limit)
    return fleet_report(client.store.telemetry(), events, client.store.drive_metrics())


def compare_drives(
    client: FleetClient,
    left_drive_id: str,
    right_drive_id: str,
    metric_names: Sequence[str] | None = None,
) -> DataFrame:
    left = client.metrics(left_drive_id)
    right = client.metrics(right_drive_id)
    return comparison_report(left, right, left_drive_id, right_drive_id, metric_names)


def generate_analysis(
    client: FleetClient,
    drive_id: str | None = None,
    compare_to: str | None = None,
    event_limit: int | None = None,
) -> DataFrame:
    """Fleet report, drive report or comparison, by the names given."""
    if drive_id is None:
        if compare_to is not None:
            raise ValueError("drive_id is required when compare_to is provided.")
        return analyze_fleet(client, event_limit)
    if compare_to is not None:
        return compare_drives(client, drive_id, compare_to)
    return analyze_drive(client, drive_id, event_limit=event_limit)


def as_json(frame: DataFrame) -> DataFrame:
    """Each row as one JSON text in column `json`; NULL stays null, times are ISO text."""
    return frame.select(F.to_json(F.struct("*"), _JSON).alias("json"))


def as_dict(report: DataFrame) -> dict[str, Any]:
    """A one-row report as a Python dictionary."""
    return json.loads(as_json(report).first().json)


def sample_rows(telemetry: DataFrame, limit: int = SAMPLE_ROWS) -> DataFrame:
    """The first rows in time order with the time as ISO text; none if limit is not positive."""
    if limit <= 0:
        rows = telemetry.limit(0)
    else:
        rows = first_telemetry(telemetry, limit)
    return rows.withColumn("timestamp", iso_text(F.col("timestamp")))


@dataclass(frozen=True)
class Overview:
    """What an overview page shows. `drives` grows with the fleet, so it stays a DataFrame."""

    status: str
    summary: DataFrame
    sample: DataFrame
    drives: DataFrame
    fleet_report: DataFrame | None


# Headings of the overview page.
OVERVIEW_SECTIONS = (
    "Telemetry Overview",
    "Performance Metrics",
    "Driving Events",
    "Automated Insights",
    "Scenario Analysis",
)


def drive_names(metrics: DataFrame) -> DataFrame:
    """Distinct drive names, in the order of the metrics table (by name)."""
    return metrics.select("drive_id").distinct().orderBy("drive_id")


def overview(
    client: FleetClient, result: IngestResult, event_limit: int | None = None
) -> Overview:
    """Compute and store the metrics of an ingest run and describe the outcome."""
    if result.files_processed:
        status = "Telemetry, metrics, and automated analysis ready."
    else:
        status = "No telemetry data found."
    summary = summarize_ingest(result)
    sample = sample_rows(result.telemetry)
    if not result.rows_served:
        nothing = client.store.drive_metrics().select("drive_id").limit(0)
        return Overview(status, summary, sample, nothing, None)
    computed = compute_metrics(client.store, combine_copies=False)
    report = analyze_fleet(client, event_limit)
    return Overview(status, summary, sample, drive_names(computed.drive_metrics), report)


def overview_json(page: Overview) -> DataFrame:
    """The bounded parts of an overview as one JSON text in column `json`."""
    # At most SAMPLE_ROWS rows are gathered into the array.
    ordered = page.sample.select(F.struct("timestamp", "source_file").alias("at"), _row(page.sample).alias("row"))
    rows = ordered.agg(F.array_sort(F.collect_list(F.struct("at", "row"))).alias("_rows"))
    sample = _cell(rows, F.transform("_rows", lambda pair: pair["row"]))
    if page.fleet_report is None:
        analysis = F.lit(None).cast("string")
    else:
        analysis = _cell(page.fleet_report, _row(page.fleet_report))
    body = page.summary.select(
        F.lit("analytics").alias("mode"),
        F.lit("Fleet Analytics").alias("title"),
        F.lit(page.status).alias("status"),
        F.struct(*page.summary.columns).alias("pipeline"),
        sample.alias("telemetry_sample"),
        analysis.alias("fleet_analysis"),
        F.array(*[F.lit(name) for name in OVERVIEW_SECTIONS]).alias("sections"),
    )
    return as_json(body)
