"""Raw telemetry rows derived from the given `events` table.

Every event becomes one sample of the drive `drive_<user_id>`. Time is compressed
by 50,000 so that pauses fall around the event and sampling limits. To exercise
the cleaning rules some samples get a repeated copy, an unreadable epoch, an
impossible position or a missing reading. All rows of `events` take part.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wheeltrace.operators.canonical import to_telemetry
from wheeltrace.operators.cleaning import clean, coerce_columns
from wheeltrace.operators.detection import detect_events
from wheeltrace.operators.metrics import drive_metrics
from wheeltrace.operators.samples import drive_intervals, prepare_samples
from wheeltrace.operators.scale import checkpoint_folder, materialize
from wheeltrace.sources.store import TelemetryStore

# Rows per stretch of a derived "file", the stand-in for a CSV split.
_ROWS_PER_CHUNK = 1_000_000

_RAW = f"""
WITH base AS (
  SELECT event_id, concat('drive_', user_id) AS drive_id,
         1704067200000000 + (unix_micros(cast(ts AS timestamp)) - 1704067200000000) div 50000
           AS epoch_us,
         cast(get_json_object(props, '$.k') AS int) AS k, value, event_type
  FROM {{events}}),
copies AS (
  SELECT *, event_id * 2 + bump AS ord
  FROM base
  LATERAL VIEW explode(sequence(0, CASE WHEN event_id % 50 = 1 THEN 1 ELSE 0 END)) AS bump)
SELECT
  concat(drive_id, '.csv') AS source_file, drive_id,
  ord div {_ROWS_PER_CHUNK} AS _chunk, ord AS _pos,
  CASE WHEN event_id % 97 = 0 THEN 'bad'
       ELSE concat(cast(epoch_us div 1000000 AS string), '.',
                   lpad(cast(epoch_us % 1000000 AS string), 6, '0')) END AS `Time (epoch)`,
  concat(lpad(cast(k % 24 AS string), 2, '0'), ':', lpad(cast(event_id % 60 AS string), 2, '0'),
         ':', lpad(cast(k % 60 AS string), 2, '0')) AS `Time_Elapsed`,
  CASE WHEN event_id % 83 = 0 THEN 'n/a' ELSE cast(k + bump AS string) END AS `veh_speed (kph)`,
  CASE WHEN event_id % 71 = 0 THEN NULL
       ELSE cast(event_id * 2 + (event_id % 7) * 100 AS double) / 200 END AS `veh_odometer (km)`,
  CASE WHEN event_id % 61 = 0 THEN 123.5D ELSE 37 + k / 1000D END AS `gps_latitude (deg)`,
  CASE WHEN event_id % 67 = 0 THEN -200D ELSE -122 + k / 1000D END AS `gps_longitude (deg)`,
  (k - 50) / 8D AS `RCM_longitudinalAccel (m/s^2)`,
  ((event_id * 37) % 100 - 50) / 10D AS `RCM_lateralAccel (m/s^2)`,
  cast(k - 50 AS double) AS `veh_steering_angle (deg)`,
  CASE WHEN event_id % 2 = 0 THEN value * 3 ELSE -value * 3 END AS `veh_steering_speedps (D/S)`,
  CASE event_id % 5 WHEN 0 THEN 'Driver_applying_brakes|2' WHEN 1 THEN 'Not_applying|1'
       WHEN 2 THEN '1' WHEN 3 THEN '0' END AS `ESP_driverBrakeApply`,
  CASE event_type WHEN 'click' THEN 'ACTIVE_NOMINAL|3' WHEN 'view' THEN 'UNAVAILABLE|1'
       WHEN 'signup' THEN 'active_restricted|4' WHEN 'purchase' THEN 'AVAILABLE' END
    AS `DAS_autopilotState`,
  CASE k % 3 WHEN 0 THEN 'HIGHWAY|1' WHEN 1 THEN 'CITY|RING|2' ELSE '|0' END AS `UI_roadClass`,
  CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS `APP_environmentRainy`,
  CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END AS `APP_environmentSnowy`,
  50 + k / 4D AS `BMS_socAvg (per)`, k % 6 AS `# Vehicles`
FROM copies
"""


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source rows as a CSV scan would give them: source column names, lineage, position."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(_RAW, events=events)


def coerced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coerce_columns(raw_rows(spark, sf_dir))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical telemetry, computed from the raw rows."""
    # Written, as odometer steps look at the cleaned rows from two sides.
    return to_telemetry(materialize(clean(coerced_rows(spark, sf_dir)), "clean-rows"))


_stores: dict[tuple[str, str], TelemetryStore] = {}
_written: set[tuple[str, str]] = set()
_intervals: dict[str, DataFrame] = {}


def store(spark: SparkSession, sf_dir: str, *tables: str) -> TelemetryStore:
    """A store with the named tables for the data at `sf_dir`.

    As in production, telemetry is written once, events and drive metrics are
    computed from it once, and queries read the tables. A table is written when
    a query of the session first needs it.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        _stores[key] = TelemetryStore(
            spark, f"{checkpoint_folder(spark)}/store-{uuid.uuid4().hex}"
        )
    target = _stores[key]

    def build(table: str, write: Callable[[], object]) -> None:
        if (target.root, table) not in _written:
            write()
            _written.add((target.root, table))

    if tables:
        build("telemetry", lambda: target.write_telemetry(telemetry(spark, sf_dir)))
    if "events" in tables or "metrics" in tables:
        build("events", lambda: target.write_events(_events(target)))
    if "metrics" in tables:
        build(
            "metrics",
            lambda: target.write_drive_metrics(
                drive_metrics(target.telemetry(), target.events(), intervals=_of_drives(target))
            ),
        )
    return target


def _of_drives(target: TelemetryStore) -> DataFrame:
    """Intervals of the drives of a store, one row per drive, for its events and its metrics.

    Repeated samples are gone from the store, so copies need not be combined first.
    """
    if target.root not in _intervals:
        found = drive_intervals(prepare_samples(target.telemetry()), combine_copies=False)
        _intervals[target.root] = materialize(found, "intervals")
    return _intervals[target.root]


def _events(target: TelemetryStore) -> DataFrame:
    return detect_events(
        target.telemetry(), intervals=_of_drives(target), combine_copies=False
    )


def stored_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir, "telemetry").telemetry()


def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir, "events").events()


def stored_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir, "metrics").drive_metrics()
