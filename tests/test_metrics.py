import pytest
from helpers import sample, telemetry_frame

from wheeltrace.operators.detection import detect_events
from wheeltrace.operators.metrics import drive_metrics, drive_summary, fleet_metrics
from wheeltrace.operators.samples import drive_intervals, prepare_samples
from wheeltrace.schemas import DRIVE_METRIC_SCHEMA


def test_weights_and_totals(spark):
    rows = [
        sample("d", 0, autopilot_state="ACTIVE_NOMINAL", distance_delta_km=1.0),
        sample("d", 1_000_000, autopilot_state="active_restricted", distance_delta_km=-2.0),
        sample("d", 3_000_000, autopilot_state="AVAILABLE", speed_kph=None),
        # Ten seconds to the next sample: counts as the median of 1 and 2 seconds.
        sample("d", 13_000_000, autopilot_state="ACTIVE_NOMINAL", distance_delta_km=None),
    ]
    rows[2], rows[3] = (
        {**rows[2], "autopilot_state": "ACTIVE_NOMINAL"},
        {**rows[3], "speed_kph": 80.0},
    )
    got = drive_metrics(telemetry_frame(spark, rows)).first()
    assert got.duration_s == 13.0
    assert got.distance_km == 1.01
    assert got.average_speed_kph == 60.0
    assert got.max_speed_kph == 80.0
    assert got.autopilot_active_time_s == 1 + 2 + 1.5 + 1.5
    assert got.autopilot_active_pct == 46.154
    assert got.total_events == 0 and got.events_per_100_km == 0.0


def test_repeated_instants_weigh_the_fallback(spark):
    rows = [sample("d", us, autopilot_state="ACTIVE_NOMINAL") for us in (0, 0, 0, 2_000_000)]
    got = drive_metrics(telemetry_frame(spark, rows)).first()
    # Two zero pauses and the last sample take the median (2 s), one takes its own 2 s.
    assert got.autopilot_active_time_s == 8.0
    rows[1]["autopilot_state"] = None
    samples = prepare_samples(telemetry_frame(spark, rows))
    apart = drive_intervals(samples, combine_copies=False).first()
    assert apart == drive_intervals(samples).first() and apart.active_time_s == 6.0


def test_single_sample_drive(spark):
    got = drive_metrics(telemetry_frame(spark, [sample("d", 0, speed_kph=None)])).first()
    assert (got.duration_s, got.average_speed_kph, got.autopilot_active_pct) == (0.0, 0.0, 0.0)


def test_counts_come_from_given_events(spark):
    rows = [sample(d, i * 400_000, lateral_accel_mps2=3.0) for d in "ab" for i in range(4)]
    frame = telemetry_frame(spark, rows)
    events = detect_events(frame)
    got = {r.drive_id: r for r in drive_metrics(frame, events.where("drive_id = 'a'")).collect()}
    assert got["a"].high_lateral_accel_count == 1 and got["b"].high_lateral_accel_count == 0
    assert got["a"].high_lateral_accel_per_100_km == got["a"].events_per_100_km == 2500.0
    own = drive_metrics(frame)
    assert [r.total_events for r in own.collect()] == [1, 1]
    assert own.schema.simpleString() == DRIVE_METRIC_SCHEMA.simpleString()


def test_fleet_weights_speed_by_time(spark):
    rows = [sample("a", i * 1_000_000, speed_kph=100.0) for i in range(11)]
    rows += [sample("b", i * 1_000_000, speed_kph=10.0) for i in range(31)]
    got = fleet_metrics(drive_metrics(telemetry_frame(spark, rows))).first()
    assert (got.drives, got.duration_s, got.average_speed_kph) == (2, 40.0, 32.5)
    assert got.max_speed_kph == 100.0


def test_fleet_of_instants_takes_plain_mean(spark):
    rows = [sample("a", 0, speed_kph=100.0), sample("b", 0, speed_kph=10.0)]
    got = fleet_metrics(drive_metrics(telemetry_frame(spark, rows))).first()
    assert (got.duration_s, got.average_speed_kph) == (0.0, 55.0)


def test_empty_fleet_is_one_row_of_zeros(spark):
    empty = spark.createDataFrame([], DRIVE_METRIC_SCHEMA)
    assert [value for value in fleet_metrics(empty).first()] == [0] * 18


def test_drive_summary_counts_known_states(spark):
    states = [None, "UNAVAILABLE", "AVAILABLE", "ACTIVE_NOMINAL"]
    rows = [sample("d", i, autopilot_state=state) for i, state in enumerate(states)]
    got = drive_summary(telemetry_frame(spark, rows)).first()
    assert (got.samples, got.autopilot_samples) == (4, 2)
    assert got.distance_km == pytest.approx(0.04)


def test_intervals_are_not_broadcast(spark, tmp_path):
    """One row per drive, which metrics look up by shuffle."""
    rows = telemetry_frame(spark, [sample(f"d{k}", at * 400_000) for k in range(4) for at in range(3)])
    intervals = drive_intervals(prepare_samples(rows))
    intervals.write.parquet(str(tmp_path / "intervals"))
    written = spark.read.parquet(str(tmp_path / "intervals"))
    events = spark.createDataFrame([], "drive_id string, event_type string")
    found = drive_metrics(rows, events, intervals=written)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter, (drive_id" in plan and "rightHint=(strategy=merge)" in plan
    assert found.count() == 4
