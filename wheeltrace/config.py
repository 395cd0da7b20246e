"""Detection rules, table names and the widths that bound per-task work."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

TELEMETRY_TABLE = "telemetry"
EVENTS_TABLE = "driving_events"
DRIVE_METRICS_TABLE = "drive_metrics"
INGESTION_TABLE = "ingestion_runs"

SECOND_US = 1_000_000

# Samples at most this far apart belong to the same event.
EVENT_COOLDOWN_US = 500_000
# Shorter events are dropped.
MIN_EVENT_DURATION_US = 300_000
# A longer pause between two samples does not count as driving time.
MAX_SAMPLE_GAP_US = 5 * SECOND_US

# One drive may hold a third of all rows, so no window runs over a whole drive.
# Time-ordered work is cut into cells of this width first. A cell holds at most
# one row per microsecond because samples are pre-aggregated per instant.
FINE_CELL_US = 60 * SECOND_US
# Events that touch a fine cell's edge are merged again in cells of this width.
COARSE_CELL_US = 6 * 3600 * SECOND_US


@dataclass(frozen=True)
class EventRule:
    """One threshold detector.

    `peak` says which sample stands for the event: "min", "max" or "max_abs".
    It also gives the default test (at or beyond the threshold on that side);
    `hit` replaces that test.
    """

    event_type: str
    column: str
    threshold: float
    severe_reference: float
    peak: str = "max"
    hit: Callable[[Column], Column] | None = None

    def matches(self, value: Column) -> Column:
        if self.hit is not None:
            return self.hit(value)
        if self.peak == "min":
            return value <= self.threshold
        if self.peak == "max_abs":
            # Two plain comparisons can be pushed to the Parquet reader; abs() cannot.
            return (value >= self.threshold) | (value <= -self.threshold)
        return value >= self.threshold

    def strength(self, value: Column) -> Column:
        if self.peak == "min":
            return -value
        if self.peak == "max_abs":
            return F.abs(value)
        return value


# Thresholds and severe references of the four detectors.
HARD_BRAKING = EventRule("hard_braking", "longitudinal_accel_mps2", -3.0, -5.5, "min")
RAPID_ACCELERATION = EventRule("rapid_acceleration", "longitudinal_accel_mps2", 2.5, 3.6, "max")
SHARP_STEERING = EventRule("sharp_steering", "steering_rate_deg_s", 120.0, 500.0, "max_abs")
HIGH_LATERAL_ACCEL = EventRule("high_lateral_accel", "lateral_accel_mps2", 2.5, 4.0, "max_abs")

DEFAULT_RULES = (HARD_BRAKING, RAPID_ACCELERATION, SHARP_STEERING, HIGH_LATERAL_ACCEL)
EVENT_TYPES = tuple(rule.event_type for rule in DEFAULT_RULES)

# States in which the driver assistance is steering.
ACTIVE_AUTOPILOT_STATES = ("ACTIVE_NOMINAL", "ACTIVE_RESTRICTED")
