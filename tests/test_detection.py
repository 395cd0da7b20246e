import random

import pytest
from helpers import BASE_US, brute_force_runs, sample, telemetry_frame
from pyspark.sql import functions as F

from wheeltrace.config import COARSE_CELL_US, DEFAULT_RULES, FINE_CELL_US, EventRule
from wheeltrace.operators.detection import (
    _possible_matches,
    detect_events,
    detect_hard_braking,
    detect_sharp_steering,
    threshold_runs,
)
from wheeltrace.operators.metrics import drive_metrics
from wheeltrace.operators.samples import drive_intervals, prepare_samples

SECOND = 1_000_000


def events_of(frame, *widths):
    rows = detect_events(frame, fine_us=widths[0], coarse_us=widths[1]) if widths else (
        detect_events(frame)
    )
    return sorted(
        (
            r.event_type, r.drive_id, r.s, r.e, r.peak_value, r.autopilot_active,
        )
        for r in rows.select(
            "*", F.unix_micros("start_time").alias("s"), F.unix_micros("end_time").alias("e")
        ).collect()
    )


def random_rows(seed, hot=400):
    """Drives with quiet stretches and long runs; the first drive holds most rows."""
    chance = random.Random(seed)
    rows = []
    for drive, size in (("hot", hot), ("a", 60), ("b", 60), ("c", 1)):
        us = 0
        strong = 0.0
        for _ in range(size):
            us += chance.choice([100_000, 250_000, 500_000, 500_001, 700_000, 6 * SECOND])
            strong = chance.choice([strong, strong, strong, 0.0, -4.0, 3.0])
            rows.append(
                sample(
                    drive,
                    us,
                    longitudinal_accel_mps2=strong,
                    lateral_accel_mps2=chance.choice([None, 0.0, strong, -strong]),
                    steering_rate_deg_s=chance.choice([0.0, 130.0, -600.0]),
                    autopilot_state=chance.choice([None, "ACTIVE_NOMINAL", "AVAILABLE"]),
                    distance_delta_km=chance.choice([None, 0.02]),
                )
            )
    chance.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force_for_any_cell_width(spark, seed):
    rows = random_rows(seed)
    frame = telemetry_frame(spark, rows)
    expected = brute_force_runs(rows)
    assert len(expected) > 50
    assert events_of(frame) == expected
    assert events_of(frame, 5 * SECOND, 20 * SECOND) == expected
    assert events_of(frame, 7 * SECOND, 7 * SECOND) == expected


def test_one_event_across_many_cells(spark):
    rows = [sample("d", i * 500_000, longitudinal_accel_mps2=-4.0) for i in range(200)]
    frame = telemetry_frame(spark, rows)
    events = detect_events(frame, fine_us=5 * SECOND, coarse_us=15 * SECOND).collect()
    assert len(events) == 1
    assert events[0].duration_s == 99.5
    assert events[0].distance_km == 2.0


def test_gap_of_exactly_the_cooldown_does_not_split(spark):
    rows = [sample("d", us, steering_rate_deg_s=200.0) for us in (0, 500_000, 1_000_001)]
    events = detect_sharp_steering(telemetry_frame(spark, rows)).orderBy("start_time").collect()
    assert [event.duration_s for event in events] == [0.5, 0.0]


def test_single_sample_needs_a_long_sample_interval(spark):
    def rows(step):
        return [
            sample("d", i * step, longitudinal_accel_mps2=-4.0 if i == 2 else 0.0)
            for i in range(5)
        ]

    assert detect_hard_braking(telemetry_frame(spark, rows(299_999))).count() == 0
    kept = detect_hard_braking(telemetry_frame(spark, rows(300_000))).collect()
    assert [event.duration_s for event in kept] == [0.0]


def test_lone_sample_is_no_event(spark):
    assert detect_hard_braking(
        telemetry_frame(spark, [sample("d", 0, longitudinal_accel_mps2=-9.0)])
    ).count() == 0


def test_copies_of_one_instant_do_not_change_the_events(spark):
    rows = [sample("d", i * 400_000, lateral_accel_mps2=3.0) for i in range(5)]
    copies = rows + [dict(rows[2]) for _ in range(500)]
    events = detect_events(telemetry_frame(spark, copies)).collect()
    assert len(events) == 1
    assert events[0].duration_s == 1.6
    assert events[0].distance_km == pytest.approx(5.05)


def test_numbers_run_across_drives_by_type(spark):
    rows = []
    for drive in ("b", "a", "c"):
        for i in range(12):
            strong = i % 4 == 0
            rows.append(sample(drive, i * 400_000, steering_rate_deg_s=130.0 * strong))
    events = detect_events(telemetry_frame(spark, rows)).orderBy("event_id").collect()
    names = [event.event_id for event in events]
    assert names == [
        f"{drive}:sharp_steering:{number:05d}"
        for drive, first in (("a", 1), ("b", 4), ("c", 7))
        for number in range(first, first + 3)
    ]


def test_first_and_last_values_keep_null(spark):
    rows = [
        sample("d", 0, longitudinal_accel_mps2=-4.0, speed_kph=None, rainy=True, road_class=None),
        sample("d", 400_000, longitudinal_accel_mps2=-5.0, speed_kph=40.0),
        sample("d", 800_000, longitudinal_accel_mps2=-4.0, speed_kph=None),
    ]
    event = detect_hard_braking(telemetry_frame(spark, rows)).first()
    assert (event.start_speed_kph, event.end_speed_kph, event.road_class) == (None, None, None)
    assert event.rainy and not event.snowy
    assert (event.peak_value, event.severity_score, event.severity) == (-5.0, 0.8, "high")


def test_missing_columns(spark):
    frame = telemetry_frame(spark, [sample("d", 0)])
    with pytest.raises(ValueError, match="autopilot_state, speed_kph"):
        detect_events(frame.drop("speed_kph", "autopilot_state")).count()
    bare = frame.drop("source_file", "road_class", "rainy", "snowy")
    assert detect_events(bare).count() == 0


def test_empty_input(spark):
    frame = telemetry_frame(spark, [sample("d", 0)]).limit(0)
    assert detect_events(frame).count() == 0
    assert drive_metrics(frame).count() == 0


def test_nan_and_text_columns(spark):
    rows = [sample("d", i * 400_000, steering_rate_deg_s=float("nan")) for i in range(4)]
    assert detect_events(telemetry_frame(spark, rows)).count() == 0
    texts = telemetry_frame(
        spark, [sample("d", i * 400_000, steering_rate_deg_s=150.0) for i in range(4)]
    )
    texts = texts.withColumn("steering_rate_deg_s", F.col("steering_rate_deg_s").cast("string"))
    texts = texts.withColumn("timestamp", F.col("timestamp").cast("string"))
    assert detect_events(texts).count() == 1


def test_own_rule(spark):
    rows = [sample("d", i * 400_000, speed_kph=130.0 + i) for i in range(4)]
    rule = EventRule("speeding", "speed_kph", 120.0, 200.0, hit=lambda speed: speed > 131.0)
    event = detect_events(telemetry_frame(spark, rows), (rule,)).first()
    assert (event.event_type, event.peak_value, event.duration_s) == ("speeding", 133.0, 0.4)


def test_strong_signal_filter_reaches_the_reader(spark, tmp_path):
    path = str(tmp_path / "telemetry")
    telemetry_frame(spark, [sample("d", 0)]).write.parquet(path)
    plan = _possible_matches(spark.read.parquet(path), DEFAULT_RULES)
    text = plan._jdf.queryExecution().toString()
    pushed = text.split("PushedFilters: [")[1].splitlines()[0]
    assert pushed.startswith("Or(Or(Or(LessThanOrEqual(longitudinal_accel_mps2,-3.0)")


def test_no_window_runs_over_a_whole_drive(spark):
    rows = random_rows(3, hot=30)
    plan = drive_metrics(telemetry_frame(spark, rows))._jdf.queryExecution().toString()
    windows = [line for line in plan.splitlines() if "windowspecdefinition(drive_id" in line]
    assert windows
    for line in windows:
        assert "_cell" in line


def test_intervals_for_any_cell_width(spark):
    rows = random_rows(4)
    samples = prepare_samples(telemetry_frame(spark, rows))
    expected = {r.drive_id: r.asDict() for r in drive_intervals(samples, FINE_CELL_US).collect()}
    for width in (5 * SECOND, 11 * SECOND):
        assert {r.drive_id: r.asDict() for r in drive_intervals(samples, width).collect()} == (
            expected
        )
    loose = drive_intervals(samples, combine_copies=False).collect()
    assert {r.drive_id: r.asDict() for r in loose} == expected
    assert COARSE_CELL_US % FINE_CELL_US == 0 and BASE_US % SECOND == 0


def test_only_runs_at_an_edge_and_keys_travel_again(spark, tmp_path):
    """Whole runs are shuffled into fine cells and to their numbers, nowhere else."""
    frame = telemetry_frame(spark, random_rows(5))
    shared = drive_intervals(prepare_samples(frame), combine_copies=False)
    plan = detect_events(frame, intervals=shared, combine_copies=False)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    # The runs are read from written tables; what joins them is their number.
    assert "windowspecdefinition(drive_id" not in text and text.count("Join Inner") == 2
    samples = prepare_samples(frame, tuple(rule.column for rule in DEFAULT_RULES))
    inside, wider = threshold_runs(samples, DEFAULT_RULES, combine_copies=False)
    assert inside.count() > 0 and wider.count() > 0
    edge = 500_000
    for row in inside.select("first.moment_us", F.col("last.moment_us").alias("end")).collect():
        assert row.moment_us % FINE_CELL_US > edge and -row.end % FINE_CELL_US > edge


@pytest.mark.parametrize("widths", [(FINE_CELL_US, COARSE_CELL_US), (5 * SECOND, 15 * SECOND)])
def test_copies_need_not_be_combined(spark, widths):
    frame = telemetry_frame(spark, random_rows(6, hot=200))
    frame = frame.unionByName(frame.where("drive_id = 'a'"))
    found = [
        sorted(map(tuple, detect_events(frame, DEFAULT_RULES, *widths, combine_copies=way).collect()))
        for way in (True, False)
    ]
    assert found[0] and str(found[0]) == str(found[1])
