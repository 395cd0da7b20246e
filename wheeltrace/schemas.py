"""Column lists and schemas of the tables this package reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

# Source columns without which a log cannot be analysed.
REQUIRED_SOURCE_COLUMNS = (
    "Time (epoch)",
    "veh_speed (kph)",
    "veh_odometer (km)",
    "gps_latitude (deg)",
    "gps_longitude (deg)",
    "RCM_longitudinalAccel (m/s^2)",
    "RCM_lateralAccel (m/s^2)",
    "veh_steering_angle (deg)",
    "ESP_driverBrakeApply",
    "DAS_autopilotState",
    "BMS_socAvg (per)",
    "# Vehicles",
)

# Source columns read as numbers.
NUMERIC_SOURCE_COLUMNS = (
    "Time (epoch)",
    "Time (abs)",
    "veh_elevation (M)",
    "gps_accuracy (m)",
    "gps_latitude (deg)",
    "gps_longitude (deg)",
    "UI_gpsVehicleHeading (deg)",
    "veh_odometer (km)",
    "veh_speed (kph)",
    "pedal_accel (per)",
    "veh_steering_angle (deg)",
    "veh_steering_speedps (D/S)",
    "RCM_longitudinalAccel (m/s^2)",
    "RCM_lateralAccel (m/s^2)",
    "RCM_verticalAccel (m/s^2)",
    "APP_environmentRainy",
    "APP_environmentSnowy",
    "BMS_packCurrent (A)",
    "BMS_packVoltage (V)",
    "BMS_socAvg (per)",
    "DAS_controlDistance (m)",
    "DAS_setSpeed (kph)",
    "# Vehicles",
)

# Source columns read as text.
TEXT_SOURCE_COLUMNS = (
    "Time_Elapsed",
    "ESP_driverBrakeApply",
    "DAS_autopilotState",
    "DAS_accState",
    "DAS_aebEvent",
    "UI_roadClass",
)

EPOCH = "Time (epoch)"

# Position of a row in its source file. `_chunk` names a bounded stretch of the
# file (a CSV split), `_pos` orders the rows inside it; chunks are ordered too.
CHUNK = "_chunk"
POSITION = "_pos"
LINEAGE_COLUMNS = ("source_file", "drive_id", CHUNK, POSITION)

TELEMETRY_SCHEMA = T.StructType(
    [
        T.StructField("source_file", T.StringType()),
        T.StructField("drive_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("elapsed_seconds", T.DoubleType()),
        T.StructField("speed_kph", T.DoubleType()),
        T.StructField("speed_mps", T.DoubleType()),
        T.StructField("odometer_km", T.DoubleType()),
        T.StructField("distance_delta_km", T.DoubleType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("gps_accuracy_m", T.DoubleType()),
        T.StructField("heading_deg", T.DoubleType()),
        T.StructField("elevation_m", T.DoubleType()),
        T.StructField("longitudinal_accel_mps2", T.DoubleType()),
        T.StructField("lateral_accel_mps2", T.DoubleType()),
        T.StructField("vertical_accel_mps2", T.DoubleType()),
        T.StructField("steering_angle_deg", T.DoubleType()),
        T.StructField("steering_rate_deg_s", T.DoubleType()),
        T.StructField("accelerator_pct", T.DoubleType()),
        T.StructField("brake_applied", T.BooleanType()),
        T.StructField("autopilot_state", T.StringType()),
        T.StructField("autopilot_state_code", T.DoubleType()),
        T.StructField("acc_state", T.StringType()),
        T.StructField("aeb_state", T.StringType()),
        T.StructField("road_class", T.StringType()),
        T.StructField("road_class_code", T.DoubleType()),
        T.StructField("rainy", T.BooleanType()),
        T.StructField("snowy", T.BooleanType()),
        T.StructField("battery_soc_pct", T.DoubleType()),
        T.StructField("battery_pack_current_a", T.DoubleType()),
        T.StructField("battery_pack_voltage_v", T.DoubleType()),
        T.StructField("lead_vehicle_distance_m", T.DoubleType()),
        T.StructField("set_speed_kph", T.DoubleType()),
        T.StructField("vehicles_detected", T.DoubleType()),
    ]
)
TELEMETRY_COLUMNS = tuple(TELEMETRY_SCHEMA.names)

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("drive_id", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("start_time", T.TimestampType()),
        T.StructField("end_time", T.TimestampType()),
        T.StructField("duration_s", T.DoubleType()),
        T.StructField("severity_score", T.DoubleType()),
        T.StructField("severity", T.StringType()),
        T.StructField("peak_value", T.DoubleType()),
        T.StructField("start_speed_kph", T.DoubleType()),
        T.StructField("end_speed_kph", T.DoubleType()),
        T.StructField("distance_km", T.DoubleType()),
        T.StructField("autopilot_active", T.BooleanType()),
        T.StructField("road_class", T.StringType()),
        T.StructField("rainy", T.BooleanType()),
        T.StructField("snowy", T.BooleanType()),
    ]
)
EVENT_COLUMNS = tuple(EVENT_SCHEMA.names)

DRIVE_METRIC_SCHEMA = T.StructType(
    [
        T.StructField("drive_id", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("start_time", T.TimestampType()),
        T.StructField("end_time", T.TimestampType()),
        T.StructField("duration_s", T.DoubleType()),
        T.StructField("distance_km", T.DoubleType()),
        T.StructField("average_speed_kph", T.DoubleType()),
        T.StructField("max_speed_kph", T.DoubleType()),
        T.StructField("autopilot_active_time_s", T.DoubleType()),
        T.StructField("autopilot_active_distance_km", T.DoubleType()),
        T.StructField("autopilot_active_pct", T.DoubleType()),
        T.StructField("hard_braking_count", T.LongType()),
        T.StructField("hard_braking_per_100_km", T.DoubleType()),
        T.StructField("rapid_acceleration_count", T.LongType()),
        T.StructField("rapid_acceleration_per_100_km", T.DoubleType()),
        T.StructField("sharp_steering_count", T.LongType()),
        T.StructField("sharp_steering_per_100_km", T.DoubleType()),
        T.StructField("high_lateral_accel_count", T.LongType()),
        T.StructField("high_lateral_accel_per_100_km", T.DoubleType()),
        T.StructField("total_events", T.LongType()),
        T.StructField("events_per_100_km", T.DoubleType()),
    ]
)
DRIVE_METRIC_COLUMNS = tuple(DRIVE_METRIC_SCHEMA.names)

INGESTION_RUN_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("files_processed", T.LongType()),
        T.StructField("rows_ingested", T.LongType()),
        T.StructField("rows_served", T.LongType()),
        T.StructField("rows_dropped", T.LongType()),
        T.StructField("duplicate_rows_removed", T.LongType()),
        T.StructField("loaded_at", T.TimestampType()),
    ]
)
