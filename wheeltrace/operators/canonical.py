"""Projection of cleaned source rows to the canonical telemetry table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wheeltrace.functions.scalars import (
    elapsed_seconds,
    epoch_timestamp,
    is_switched_on,
    state_code,
    state_label,
)
from wheeltrace.schemas import CHUNK, EPOCH, POSITION, TELEMETRY_SCHEMA

ODOMETER = "veh_odometer (km)"
DISTANCE = "distance_delta_km"


def add_distance_delta(rows: DataFrame) -> DataFrame:
    """Odometer step from the previous row of the drive in file order, never negative.

    The window runs inside one chunk of the file, whose size the reader bounds.
    The first row of a chunk takes the last reading of the chunk before it from
    a table with one row per chunk.
    """
    odometer = F.col(f"`{ODOMETER}`")
    tails = rows.groupBy("drive_id", CHUNK).agg(F.max_by(odometer, POSITION).alias("_tail"))
    by_chunk = Window.partitionBy("drive_id").orderBy(CHUNK)
    before = tails.select("drive_id", CHUNK, F.lag("_tail").over(by_chunk).alias("_tail_before"))

    inside = Window.partitionBy("drive_id", CHUNK).orderBy(POSITION)
    step = odometer - F.when(F.col("_row") == 1, F.col("_tail_before")).otherwise(F.col("_previous"))
    return (
        rows.withColumn("_row", F.row_number().over(inside))
        .withColumn("_previous", F.lag(odometer).over(inside))
        .join(before, ["drive_id", CHUNK], "left")
        .withColumn(DISTANCE, F.when(step < 0, F.lit(0.0)).otherwise(step))
        .drop("_row", "_previous", "_tail_before")
    )


def to_telemetry(cleaned: DataFrame) -> DataFrame:
    """Cleaned rows to the 34 canonical columns.

    The result is a set of rows; sort when serving (`timestamp`, `source_file`).
    """
    present = set(cleaned.columns)

    def source(name: str) -> Column:
        return F.col(f"`{name}`") if name in present else F.lit(None)

    def text(name: str) -> Column:
        return source(name).cast("string")

    if "Time_Elapsed" in present:
        elapsed = elapsed_seconds(text("Time_Elapsed"))
    else:
        elapsed = source("Time (abs)")
    speed = source("veh_speed (kph)")

    def flag(name: str) -> Column:
        # These columns were coerced to numbers: any number but zero is on.
        return F.coalesce(source(name).cast("double") != 0.0, F.lit(False))

    values = {
        "source_file": F.col("source_file"),
        "drive_id": F.col("drive_id"),
        "timestamp": epoch_timestamp(source(EPOCH)),
        "elapsed_seconds": elapsed,
        "speed_kph": speed,
        "speed_mps": speed / 3.6,
        "odometer_km": source(ODOMETER),
        "distance_delta_km": F.col(DISTANCE),
        "latitude": source("gps_latitude (deg)"),
        "longitude": source("gps_longitude (deg)"),
        "gps_accuracy_m": source("gps_accuracy (m)"),
        "heading_deg": source("UI_gpsVehicleHeading (deg)"),
        "elevation_m": source("veh_elevation (M)"),
        "longitudinal_accel_mps2": source("RCM_longitudinalAccel (m/s^2)"),
        "lateral_accel_mps2": source("RCM_lateralAccel (m/s^2)"),
        "vertical_accel_mps2": source("RCM_verticalAccel (m/s^2)"),
        "steering_angle_deg": source("veh_steering_angle (deg)"),
        "steering_rate_deg_s": source("veh_steering_speedps (D/S)"),
        "accelerator_pct": source("pedal_accel (per)"),
        "brake_applied": is_switched_on(text("ESP_driverBrakeApply")),
        "autopilot_state": state_label(text("DAS_autopilotState")),
        "autopilot_state_code": state_code(text("DAS_autopilotState")),
        "acc_state": state_label(text("DAS_accState")),
        "aeb_state": state_label(text("DAS_aebEvent")),
        "road_class": state_label(text("UI_roadClass")),
        "road_class_code": state_code(text("UI_roadClass")),
        "rainy": flag("APP_environmentRainy"),
        "snowy": flag("APP_environmentSnowy"),
        "battery_soc_pct": source("BMS_socAvg (per)"),
        "battery_pack_current_a": source("BMS_packCurrent (A)"),
        "battery_pack_voltage_v": source("BMS_packVoltage (V)"),
        "lead_vehicle_distance_m": source("DAS_controlDistance (m)"),
        "set_speed_kph": source("DAS_setSpeed (kph)"),
        "vehicles_detected": source("# Vehicles"),
    }
    return add_distance_delta(cleaned).select(
        *[
            values[field.name].cast(field.dataType).alias(field.name)
            for field in TELEMETRY_SCHEMA.fields
        ]
    )
