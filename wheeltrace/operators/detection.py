"""Driving events: runs of samples at or beyond a threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wheeltrace.config import (
    COARSE_CELL_US,
    DEFAULT_RULES,
    EVENT_COOLDOWN_US,
    FINE_CELL_US,
    HARD_BRAKING,
    HIGH_LATERAL_ACCEL,
    MIN_EVENT_DURATION_US,
    RAPID_ACCELERATION,
    SECOND_US,
    SHARP_STEERING,
    EventRule,
)
from wheeltrace.functions.scalars import cell_start, event_id, severity_label, severity_score
from wheeltrace.operators.samples import drive_intervals, prepare_samples
from wheeltrace.operators.scale import materialize, running_total, salted_join
from wheeltrace.schemas import EVENT_COLUMNS

_KEYS = ["drive_id", "event_type"]

# What a run of samples is reduced to. Every aggregate merges with itself, so
# runs can be built up from instants over cells to whole drives.
_MERGE = {
    "first": F.min,
    "last": F.max,
    "peak": F.max,
    "samples": F.sum,
    "active": F.sum,
    "distance_km": F.sum,
}


def _merged() -> list[Column]:
    return [function(name).alias(name) for name, function in _MERGE.items()]


def _merged_samples() -> list[Column]:
    """The same from candidate samples, which travel as plain columns, at half the width."""
    values = {
        "first": F.struct("moment_us", "source_file", "speed_kph", "road_class", "rainy", "snowy"),
        # An event takes only time and speed from its last sample.
        "last": F.struct("moment_us", "source_file", "speed_kph"),
        # Of equally strong samples the earliest gives the peak.
        "peak": F.struct("strength", (-F.col("moment_us")).alias("earliest"), "value"),
        "samples": F.lit(1).cast("bigint"),
        "active": F.col("is_active").cast("bigint"),
        "distance_km": F.col("distance_delta_km"),
    }
    return [function(values[name]).alias(name) for name, function in _MERGE.items()]


def candidate_samples(samples: DataFrame, rules: Sequence[EventRule]) -> DataFrame:
    """One row per sample and rule it matches.

    The rules become an exploded array, not a union, so the samples are read
    once; samples that match none are dropped in the scan's stage.
    """
    some_match = F.lit(False)
    hits = []
    for rule in rules:
        value = F.col(rule.column)
        match = rule.matches(value)
        some_match = some_match | match
        hits.append(
            F.when(
                match,
                F.struct(
                    F.lit(rule.event_type).alias("event_type"),
                    rule.strength(value).alias("strength"),
                    value.alias("value"),
                ),
            )
        )
    return (
        samples.where(some_match)
        .withColumn("_hit", F.explode(F.array_compact(F.array(*hits))))
        .select(
            "drive_id",
            F.col("_hit.event_type").alias("event_type"),
            "moment_us",
            "source_file",
            "speed_kph",
            "road_class",
            "rainy",
            "snowy",
            F.col("_hit.strength").alias("strength"),
            F.col("_hit.value").alias("value"),
            "is_active",
            "distance_delta_km",
        )
    )


def _join_samples(candidates: DataFrame, width_us: int) -> DataFrame:
    """Runs of samples that lie within the cooldown of each other inside a cell."""
    keys = [*_KEYS, "_cell"]
    in_cell = Window.partitionBy(*keys).orderBy("moment_us")
    up_to_here = in_cell.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap = F.col("moment_us") - F.lag("moment_us").over(in_cell)
    return (
        candidates.withColumn("_cell", cell_start(F.col("moment_us"), width_us))
        .withColumn("_new", F.when(gap <= EVENT_COOLDOWN_US, 0).otherwise(1))
        .withColumn("_run", F.sum("_new").over(up_to_here))
        .groupBy(*keys, "_run")
        .agg(*_merged_samples())
    )


def _join_runs(runs: DataFrame, open_runs: Column, width_us: int | None) -> DataFrame:
    """Merge runs that lie within the cooldown of each other inside a cell.

    Runs that cannot have such a neighbour keep a cell of their own.
    """
    start = F.col("first.moment_us")
    cell = cell_start(start, width_us) if width_us else F.lit(0).cast("bigint")
    keys = [*_KEYS, "_open", "_cell"]
    in_cell = Window.partitionBy(*keys).orderBy("_start")
    up_to_here = in_cell.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap = F.col("_start") - F.lag("last.moment_us").over(in_cell)
    return (
        runs.select(
            *_KEYS,
            *_MERGE,
            start.alias("_start"),
            open_runs.alias("_open"),
            F.when(open_runs, cell).otherwise(start).alias("_cell"),
        )
        .withColumn("_new", F.when(gap <= EVENT_COOLDOWN_US, 0).otherwise(1))
        .withColumn("_run", F.sum("_new").over(up_to_here))
        .groupBy(*keys, "_run")
        .agg(*_merged())
    )


def _touches_edge(width_us: int) -> Column:
    start, end = F.col("first.moment_us"), F.col("last.moment_us")
    into_cell = start - cell_start(start, width_us)
    to_next = cell_start(end, width_us) + width_us - end
    return (into_cell <= EVENT_COOLDOWN_US) | (to_next <= EVENT_COOLDOWN_US)


def threshold_runs(
    samples: DataFrame,
    rules: Sequence[EventRule],
    fine_us: int = FINE_CELL_US,
    coarse_us: int = COARSE_CELL_US,
    combine_copies: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Maximal runs of matching samples no more than the cooldown apart, in two frames.

    Built in steps of bounded width: equal instants, fine cells, coarse cells,
    drives. Runs are written after the fine cells. Only those that touch a cell's
    edge, at most two per cell, go on to the wider steps, so no task ever sees a
    whole drive's samples and the other runs are not shuffled again: they are the
    first frame, those of the wider steps the second.
    `coarse_us` must be a multiple of `fine_us`.

    `combine_copies` merges samples of one instant first, as in `sample_intervals`;
    it changes no result.
    """
    if coarse_us % fine_us or fine_us <= 2 * EVENT_COOLDOWN_US:
        raise ValueError("cells must nest and be wider than two cooldowns")
    candidates = candidate_samples(samples, rules)
    if combine_copies:
        instants = candidates.groupBy(*_KEYS, "moment_us").agg(*_merged_samples())
        runs = _join_runs(instants, F.lit(True), fine_us)
    else:
        runs = _join_samples(candidates, fine_us)
    columns = [*_KEYS, *_MERGE]
    runs = materialize(runs.select(*columns), "runs")
    touching = _touches_edge(fine_us)
    wider = _join_runs(runs.where(touching), F.lit(True), coarse_us)
    wider = _join_runs(wider, _touches_edge(coarse_us), None).select(*columns)
    return runs.where(~touching), wider


def _possible_matches(telemetry: DataFrame, rules: Sequence[EventRule]) -> DataFrame:
    """Rows that may match, tested on the stored columns.

    Plain comparisons of double columns reach the Parquet reader, which skips
    row groups without any strong signal. The exact test follows on the
    normalised values.
    """
    types = dict(telemetry.dtypes)
    if any(rule.hit is not None or types.get(rule.column) != "double" for rule in rules):
        return telemetry
    possible = F.lit(False)
    for rule in rules:
        possible = possible | rule.matches(F.col(rule.column))
    return telemetry.where(possible)


def _qualifying(runs: DataFrame, intervals: DataFrame) -> DataFrame:
    """Keys and `_start_us` of the runs that last long enough to be events.

    The test needs a few columns only, so whole runs need not travel to it.
    """
    length = F.col("last.moment_us") - F.col("first.moment_us")
    keys = runs.select(
        *_KEYS,
        F.col("first.moment_us").alias("_start_us"),
        (F.col("samples") == 1).alias("_single"),
        (length >= MIN_EVENT_DURATION_US).alias("_long"),
    ).where("_single OR _long")
    gate = intervals.select("drive_id", "single_sample_counts")
    # A drive with most of the fleet's events must not end up in one join task.
    joined = salted_join(keys, gate, ["drive_id"], ["event_type", "_start_us"])
    return joined.where("NOT _single OR single_sample_counts").select(*_KEYS, "_start_us")


def _runs_and_intervals(
    telemetry: DataFrame,
    rules: Sequence[EventRule],
    fine_us: int,
    coarse_us: int,
    intervals: DataFrame | None,
    combine_copies: bool,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The two frames of runs, and the intervals unless given."""
    measures = tuple(rule.column for rule in rules)
    if intervals is None:
        intervals = drive_intervals(prepare_samples(telemetry), fine_us, combine_copies)
    samples = prepare_samples(_possible_matches(telemetry, rules), measures)
    return (*threshold_runs(samples, rules, fine_us, coarse_us, combine_copies), intervals)


def qualifying_runs(
    telemetry: DataFrame,
    rules: Sequence[EventRule],
    fine_us: int = FINE_CELL_US,
    coarse_us: int = COARSE_CELL_US,
    intervals: DataFrame | None = None,
) -> DataFrame:
    """`drive_id`, `event_type` and `_start_us` of runs that last long enough to be events.

    A run of a single sample lasts the drive's median sample interval instead of
    zero; `intervals` takes a result of `drive_intervals` to use again.
    """
    inside, wider, intervals = _runs_and_intervals(
        telemetry, rules, fine_us, coarse_us, intervals, True
    )
    return _qualifying(inside.unionByName(wider), intervals)


def _rule_value(rules: Sequence[EventRule], attribute: str) -> Column:
    pairs = [x for r in rules for x in (F.lit(r.event_type), F.lit(float(getattr(r, attribute))))]
    return F.create_map(*pairs)[F.col("event_type")]


def detect_events(
    telemetry: DataFrame,
    rules: Sequence[EventRule] = DEFAULT_RULES,
    fine_us: int = FINE_CELL_US,
    coarse_us: int = COARSE_CELL_US,
    intervals: DataFrame | None = None,
    combine_copies: bool = True,
) -> DataFrame:
    """Events of all rules in one pass, in the `driving_events` columns.

    The number in `event_id` counts the events of a type across all drives, in
    drive and time order. Only the runs' keys are tested and numbered; the runs
    then look up their number, which no two of them share.
    """
    inside, wider, intervals = _runs_and_intervals(
        telemetry, rules, fine_us, coarse_us, intervals, combine_copies
    )
    runs = inside.unionByName(materialize(wider, "wider-runs"))
    numbers = running_total(
        _qualifying(runs, intervals),
        ["event_type"],
        ["drive_id", "_start_us"],
        F.lit(1).cast("bigint"),
        "_ordinal",
    )
    start = F.col("first.moment_us").alias("_start_us")
    numbered = runs.select("*", start).join(numbers, [*_KEYS, "_start_us"])
    peak = F.col("peak.value")
    score = severity_score(
        peak, _rule_value(rules, "threshold"), _rule_value(rules, "severe_reference")
    )
    length = F.col("last.moment_us") - F.col("first.moment_us")
    return numbered.select(
        event_id(F.col("drive_id"), F.col("event_type"), F.col("_ordinal")).alias("event_id"),
        "drive_id",
        F.col("first.source_file").alias("source_file"),
        "event_type",
        F.timestamp_micros("first.moment_us").alias("start_time"),
        F.timestamp_micros("last.moment_us").alias("end_time"),
        F.bround(length / SECOND_US, 3).alias("duration_s"),
        F.bround(score, 4).alias("severity_score"),
        severity_label(score).alias("severity"),
        F.bround(peak, 4).alias("peak_value"),
        F.col("first.speed_kph").alias("start_speed_kph"),
        F.col("last.speed_kph").alias("end_speed_kph"),
        F.bround(F.coalesce("distance_km", F.lit(0.0)), 6).alias("distance_km"),
        (F.col("active") * 2 >= F.col("samples")).alias("autopilot_active"),
        F.col("first.road_class").alias("road_class"),
        F.col("first.rainy").alias("rainy"),
        F.col("first.snowy").alias("snowy"),
    ).select(*EVENT_COLUMNS)


def detect_hard_braking(telemetry: DataFrame) -> DataFrame:
    return detect_events(telemetry, (HARD_BRAKING,))


def detect_rapid_acceleration(telemetry: DataFrame) -> DataFrame:
    return detect_events(telemetry, (RAPID_ACCELERATION,))


def detect_sharp_steering(telemetry: DataFrame) -> DataFrame:
    return detect_events(telemetry, (SHARP_STEERING,))


def detect_high_lateral_acceleration(telemetry: DataFrame) -> DataFrame:
    return detect_events(telemetry, (HIGH_LATERAL_ACCEL,))
