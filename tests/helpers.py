"""Small telemetry frames and a brute-force detector to check against."""

from statistics import median

from pyspark.sql import functions as F

from wheeltrace.config import DEFAULT_RULES

SCHEMA = (
    "drive_id string, source_file string, us bigint, speed_kph double, distance_delta_km double, "
    "longitudinal_accel_mps2 double, lateral_accel_mps2 double, steering_rate_deg_s double, "
    "autopilot_state string, road_class string, rainy boolean, snowy boolean"
)
BASE_US = 1_704_067_200_000_000


def sample(drive, us, **values):
    row = {
        "drive_id": drive,
        "source_file": f"{drive}.csv",
        "us": BASE_US + us,
        "speed_kph": 50.0,
        "distance_delta_km": 0.01,
        "longitudinal_accel_mps2": 0.0,
        "lateral_accel_mps2": 0.0,
        "steering_rate_deg_s": 0.0,
        "autopilot_state": None,
        "road_class": "CITY",
        "rainy": False,
        "snowy": False,
    }
    row.update(values)
    return row


def telemetry_frame(spark, rows):
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    frame = spark.createDataFrame([tuple(row[name] for name in names) for row in rows], SCHEMA)
    return frame.withColumn("timestamp", F.timestamp_micros("us")).drop("us")


def brute_force_runs(rows):
    """(type, drive, start, end, samples, peak, active) of every event, drive by drive."""
    found = []
    for drive in sorted({row["drive_id"] for row in rows}):
        own = sorted((r for r in rows if r["drive_id"] == drive), key=lambda r: r["us"])
        times = [r["us"] for r in own]
        gaps = [b - a for a, b in zip(times, times[1:], strict=False)]
        typical = median(gaps) if gaps else 0
        for rule in DEFAULT_RULES:
            groups = []
            for row in own:
                value = row[rule.column]
                if value is None:
                    continue
                if rule.peak == "min":
                    hit = value <= rule.threshold
                elif rule.peak == "max":
                    hit = value >= rule.threshold
                else:
                    hit = abs(value) >= rule.threshold
                if not hit:
                    continue
                if groups and row["us"] - groups[-1][-1]["us"] <= 500_000:
                    groups[-1].append(row)
                else:
                    groups.append([row])
            for group in groups:
                length = group[-1]["us"] - group[0]["us"]
                if (typical if len(group) == 1 and typical > 0 else length) < 300_000:
                    continue
                values = [row[rule.column] for row in group]
                peak = {"min": min, "max": max}.get(rule.peak, lambda v: max(v, key=abs))(values)
                active = sum(row["autopilot_state"] == "ACTIVE_NOMINAL" for row in group)
                found.append(
                    (
                        rule.event_type,
                        drive,
                        group[0]["us"],
                        group[-1]["us"],
                        round(peak, 4),
                        active * 2 >= len(group),
                    )
                )
    return sorted(found)
