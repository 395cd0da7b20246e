"""The SQL that each query's result is checked against, for DuckDB.

Written straight from the definitions (windows over whole drives, one step per
rule), not from the Spark plans.
"""

from __future__ import annotations


def _half_up(value: str, digits: int) -> str:
    """Round half up on the decimal form."""
    return f"cast(round(cast({value} AS decimal(28, 9)), {digits}) AS double)"


def _round(value: str, digits: int) -> str:
    """Round half to even on the decimal form."""
    scale = 10**digits
    return f"(round_even(cast(cast({value} AS decimal(28, 9)) * {scale} AS double), 0) / {scale})"


def _millis(micros: str) -> str:
    """Microseconds to seconds with three decimals, half to even."""
    return f"(round_even({micros} / 1000, 0) / 1000)"


_SOURCE = """
base AS (
  SELECT event_id, 'drive_' || user_id AS drive_id,
         1704067200000000 + (epoch_us(ts) - 1704067200000000) // 50000 AS epoch_us,
         cast(json_extract_string(props, '$.k') AS int) AS k, value, event_type
  FROM events),
copies AS (
  SELECT *, event_id * 2 + bump AS ord
  FROM (SELECT *, unnest(generate_series(0, CASE WHEN event_id % 50 = 1 THEN 1 ELSE 0 END)) AS bump
        FROM base)),
raw AS (
  SELECT concat(drive_id, '.csv') AS source_file, drive_id, ord,
    CASE WHEN event_id % 97 = 0 THEN 'bad'
         ELSE concat(cast(epoch_us // 1000000 AS varchar), '.',
                     lpad(cast(epoch_us % 1000000 AS varchar), 6, '0')) END AS epoch_txt,
    concat(lpad(cast(k % 24 AS varchar), 2, '0'), ':', lpad(cast(event_id % 60 AS varchar), 2, '0'),
           ':', lpad(cast(k % 60 AS varchar), 2, '0')) AS elapsed_txt,
    CASE WHEN event_id % 83 = 0 THEN 'n/a' ELSE cast(k + bump AS varchar) END AS speed_txt,
    CASE WHEN event_id % 71 = 0 THEN NULL
         ELSE cast(event_id * 2 + (event_id % 7) * 100 AS double) / 200 END AS odometer_km,
    CASE WHEN event_id % 61 = 0 THEN 123.5e0 ELSE 37 + k / 1000e0 END AS latitude,
    CASE WHEN event_id % 67 = 0 THEN -200e0 ELSE -122 + k / 1000e0 END AS longitude,
    (k - 50) / 8e0 AS long_acc,
    ((event_id * 37) % 100 - 50) / 10e0 AS lat_acc,
    cast(k - 50 AS double) AS steering_angle,
    CASE WHEN event_id % 2 = 0 THEN value * 3 ELSE -value * 3 END AS steering_rate,
    CASE event_id % 5 WHEN 0 THEN 'Driver_applying_brakes|2' WHEN 1 THEN 'Not_applying|1'
         WHEN 2 THEN '1' WHEN 3 THEN '0' END AS brake_txt,
    CASE event_type WHEN 'click' THEN 'ACTIVE_NOMINAL|3' WHEN 'view' THEN 'UNAVAILABLE|1'
         WHEN 'signup' THEN 'active_restricted|4' WHEN 'purchase' THEN 'AVAILABLE' END
      AS autopilot_txt,
    CASE k % 3 WHEN 0 THEN 'HIGHWAY|1' WHEN 1 THEN 'CITY|RING|2' ELSE '|0' END AS road_txt,
    CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS rainy_num,
    CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END AS snowy_num,
    50 + k / 4e0 AS soc, cast(k % 6 AS double) AS vehicles
  FROM copies),
coerced AS (
  SELECT * EXCLUDE (epoch_txt, speed_txt),
         try_cast(epoch_txt AS double) AS epoch, try_cast(speed_txt AS double) AS speed_kph
  FROM raw),
valid AS (SELECT * FROM coerced WHERE epoch IS NOT NULL),
firsts AS (
  SELECT * FROM valid
  QUALIFY row_number() OVER (PARTITION BY source_file, epoch ORDER BY ord) = 1),
cleaned AS (
  SELECT * EXCLUDE (latitude, longitude),
         abs(latitude) > 90 OR abs(longitude) > 180 AS gps_bad,
         CASE WHEN NOT (abs(latitude) > 90 OR abs(longitude) > 180) THEN latitude END AS latitude,
         CASE WHEN NOT (abs(latitude) > 90 OR abs(longitude) > 180) THEN longitude END AS longitude
  FROM firsts),
stepped AS (
  SELECT *, odometer_km - lag(odometer_km) OVER (PARTITION BY drive_id ORDER BY ord) AS step
  FROM cleaned),
telemetry AS (
  SELECT source_file, drive_id, ord,
    cast(floor(epoch * 1000000 + 0.5) AS bigint) AS timestamp_us,
    cast(split_part(elapsed_txt, ':', 1) AS double) * 3600
      + cast(split_part(elapsed_txt, ':', 2) AS double) * 60
      + cast(split_part(elapsed_txt, ':', 3) AS double) AS elapsed_seconds,
    speed_kph, speed_kph / 3.6e0 AS speed_mps, odometer_km,
    CASE WHEN step < 0 THEN 0e0 ELSE step END AS distance_delta_km,
    latitude, longitude, long_acc AS longitudinal_accel_mps2, lat_acc AS lateral_accel_mps2,
    steering_angle AS steering_angle_deg, steering_rate AS steering_rate_deg_s,
    coalesce(brake_txt = 'Driver_applying_brakes|2' OR brake_txt = '1', false) AS brake_applied,
    CASE autopilot_txt WHEN 'ACTIVE_NOMINAL|3' THEN 'ACTIVE_NOMINAL'
         WHEN 'UNAVAILABLE|1' THEN 'UNAVAILABLE' WHEN 'active_restricted|4' THEN 'active_restricted'
         WHEN 'AVAILABLE' THEN 'AVAILABLE' END AS autopilot_state,
    CASE autopilot_txt WHEN 'ACTIVE_NOMINAL|3' THEN 3e0 WHEN 'UNAVAILABLE|1' THEN 1e0
         WHEN 'active_restricted|4' THEN 4e0 END AS autopilot_state_code,
    CASE road_txt WHEN 'HIGHWAY|1' THEN 'HIGHWAY' WHEN 'CITY|RING|2' THEN 'CITY|RING' END
      AS road_class,
    CASE road_txt WHEN 'HIGHWAY|1' THEN 1e0 WHEN 'CITY|RING|2' THEN 2e0 ELSE 0e0 END
      AS road_class_code,
    rainy_num <> 0 AS rainy, snowy_num <> 0 AS snowy, soc AS battery_soc_pct,
    vehicles AS vehicles_detected,
    coalesce(upper(split_part(autopilot_txt, '|', 1)) IN ('ACTIVE_NOMINAL', 'ACTIVE_RESTRICTED'),
             false) AS is_active
  FROM stepped)"""

_INTERVALS = """
gaps AS (
  SELECT drive_id, timestamp_us, is_active,
         lead(timestamp_us) OVER (PARTITION BY drive_id ORDER BY timestamp_us) - timestamp_us AS gap
  FROM telemetry),
intervals AS (
  SELECT drive_id,
         coalesce(quantile_cont(CASE WHEN gap > 0 AND gap <= 5000000 THEN gap END, 0.5), 0)
           AS typical_us,
         coalesce(quantile_cont(gap, 0.5) >= 300000, false) AS single_sample_counts
  FROM gaps GROUP BY drive_id),
weights AS (
  SELECT g.drive_id, g.is_active,
         CASE WHEN gap > 0 AND gap <= 5000000 THEN gap ELSE typical_us END AS weight_us,
         CASE WHEN gap <= 5000000 THEN gap END AS gap_us
  FROM gaps g JOIN intervals USING (drive_id)),
active_time AS (
  SELECT drive_id, sum(CASE WHEN is_active THEN weight_us ELSE 0 END) AS active_us
  FROM weights GROUP BY drive_id)"""

_EVENTS = f"""
hits AS (
  SELECT *, 'hard_braking' AS event_type, longitudinal_accel_mps2 AS v,
         -longitudinal_accel_mps2 AS strength, 3.0 AS threshold, 5.5 AS reference
  FROM telemetry WHERE longitudinal_accel_mps2 <= -3.0
  UNION ALL
  SELECT *, 'rapid_acceleration', longitudinal_accel_mps2, longitudinal_accel_mps2, 2.5, 3.6
  FROM telemetry WHERE longitudinal_accel_mps2 >= 2.5
  UNION ALL
  SELECT *, 'sharp_steering', steering_rate_deg_s, abs(steering_rate_deg_s), 120.0, 500.0
  FROM telemetry WHERE abs(steering_rate_deg_s) >= 120.0
  UNION ALL
  SELECT *, 'high_lateral_accel', lateral_accel_mps2, abs(lateral_accel_mps2), 2.5, 4.0
  FROM telemetry WHERE abs(lateral_accel_mps2) >= 2.5),
marked AS (
  SELECT *, CASE WHEN timestamp_us - lag(timestamp_us)
              OVER (PARTITION BY drive_id, event_type ORDER BY timestamp_us) <= 500000
            THEN 0 ELSE 1 END AS starts
  FROM hits),
grouped AS (
  SELECT *, sum(starts) OVER (PARTITION BY drive_id, event_type ORDER BY timestamp_us) AS run
  FROM marked),
runs AS (
  SELECT drive_id, event_type, first(source_file ORDER BY timestamp_us) AS source_file,
         min(timestamp_us) AS start_us, max(timestamp_us) AS end_us, count(*) AS n,
         first(v ORDER BY strength DESC, timestamp_us) AS peak,
         first(threshold)::double AS threshold, first(reference)::double AS reference,
         first(speed_kph ORDER BY timestamp_us) AS start_speed_kph,
         last(speed_kph ORDER BY timestamp_us) AS end_speed_kph,
         coalesce(sum(distance_delta_km), 0) AS distance,
         avg(CASE WHEN is_active THEN 1e0 ELSE 0e0 END) >= 0.5 AS autopilot_active,
         first(road_class ORDER BY timestamp_us) AS road_class,
         first(rainy ORDER BY timestamp_us) AS rainy, first(snowy ORDER BY timestamp_us) AS snowy
  FROM grouped GROUP BY drive_id, event_type, run),
kept AS (
  SELECT runs.*, row_number() OVER (PARTITION BY event_type ORDER BY drive_id, start_us) AS ordinal,
         least(greatest((abs(peak) - threshold) / (reference - threshold), 0), 1) AS score
  FROM runs JOIN intervals USING (drive_id)
  WHERE CASE WHEN n = 1 THEN single_sample_counts ELSE end_us - start_us >= 300000 END),
detected AS (
  SELECT printf('%s:%s:%05d', drive_id, event_type, ordinal) AS event_id, drive_id, source_file,
         event_type, start_us AS start_time_us, end_us AS end_time_us,
         {_millis("(end_us - start_us)")} AS duration_s,
         {_round("score", 4)} AS severity_score,
         CASE WHEN score >= 0.67 THEN 'high' WHEN score >= 0.34 THEN 'moderate' ELSE 'low' END
           AS severity,
         {_round("peak", 4)} AS peak_value, start_speed_kph, end_speed_kph,
         {_round("distance", 6)} AS distance_km, autopilot_active, road_class, rainy, snowy
  FROM kept)"""


def _rate(count: str, distance: str = "distance") -> str:
    rounded = _round(f"({count} / nullif({distance}, 0) * 100.0)", 4)
    return f"CASE WHEN {distance} > 0 THEN {rounded} ELSE 0e0 END"


def _share(part: str, whole: str) -> str:
    rounded = _round(f"({part} / nullif({whole}, 0) * 100.0)", 3)
    return f"CASE WHEN {whole} > 0 THEN {rounded} ELSE 0e0 END"


_KINDS = ("hard_braking", "rapid_acceleration", "sharp_steering", "high_lateral_accel")
_COUNTS_AND_RATES = ", ".join(
    f"{kind}_count, {_rate(kind + '_count')} AS {kind}_per_100_km" for kind in _KINDS
)
_TOTAL = " + ".join(f"{kind}_count" for kind in _KINDS)

_METRICS = f"""
counts AS (
  SELECT drive_id, {", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}_count" for k in _KINDS)}
  FROM detected GROUP BY drive_id),
totals AS (
  SELECT drive_id, first(source_file ORDER BY timestamp_us) AS source_file,
         min(timestamp_us) AS start_us, max(timestamp_us) AS end_us,
         coalesce(sum(distance_delta_km), 0) AS distance, avg(speed_kph) AS speed,
         max(speed_kph) AS top,
         coalesce(sum(CASE WHEN is_active THEN distance_delta_km END), 0) AS active_distance
  FROM telemetry GROUP BY drive_id),
joined AS (
  SELECT t.*, active_us / 1e6 AS active_s, active_us, (end_us - start_us) / 1e6 AS seconds,
         {", ".join(f"coalesce({k}_count, 0) AS {k}_count" for k in _KINDS)}
  FROM totals t LEFT JOIN counts USING (drive_id) JOIN active_time USING (drive_id)),
metrics AS (
  SELECT drive_id, source_file, start_us AS start_time_us, end_us AS end_time_us,
         {_millis("(end_us - start_us)")} AS duration_s, {_round("distance", 6)} AS distance_km,
         {_round("coalesce(speed, 0)", 3)} AS average_speed_kph,
         {_round("coalesce(top, 0)", 3)} AS max_speed_kph,
         {_millis("active_us")} AS autopilot_active_time_s,
         {_round("active_distance", 6)} AS autopilot_active_distance_km,
         {_share("active_s", "seconds")} AS autopilot_active_pct,
         {_COUNTS_AND_RATES}, {_TOTAL} AS total_events,
         {_rate("(" + _TOTAL + ")")} AS events_per_100_km
  FROM joined),
fleet_sums AS (
  SELECT count(DISTINCT drive_id) AS drives, sum(distance_km) AS distance, sum(duration_s) AS seconds,
         sum(average_speed_kph * duration_s) AS speed_time, avg(average_speed_kph) AS mean_speed,
         max(max_speed_kph) AS top, sum(autopilot_active_distance_km) AS active_distance,
         sum(autopilot_active_time_s) AS active_s,
         {", ".join(f"cast(sum({k}_count) AS bigint) AS {k}_count" for k in _KINDS)}
  FROM metrics),
fleet AS (
  SELECT drives, {_round("distance", 6)} AS distance_km, {_round("seconds", 3)} AS duration_s,
         {_round("CASE WHEN seconds > 0 THEN speed_time / seconds ELSE mean_speed END", 3)}
           AS average_speed_kph,
         {_round("top", 3)} AS max_speed_kph,
         {_round("active_distance", 6)} AS autopilot_active_distance_km,
         {_round("active_s", 3)} AS autopilot_active_time_s,
         {_share("active_s", "seconds")} AS autopilot_active_pct,
         {_COUNTS_AND_RATES}, {_TOTAL} AS total_events,
         {_rate("(" + _TOTAL + ")")} AS events_per_100_km
  FROM fleet_sums)"""

_SUMMARY = f"""
summary AS (
  SELECT drive_id, source_file, count(*) AS samples, min(timestamp_us) AS start_time_us,
         max(timestamp_us) AS end_time_us, {_half_up("sum(distance_delta_km)", 3)} AS distance_km,
         {_half_up("avg(speed_kph)", 2)} AS average_speed_kph,
         {_half_up("max(speed_kph)", 2)} AS max_speed_kph,
         count(*) FILTER (autopilot_state <> 'UNAVAILABLE') AS autopilot_samples
  FROM telemetry GROUP BY drive_id, source_file)"""

_NUMBERS = (
    "duration_s",
    "distance_km",
    "average_speed_kph",
    "max_speed_kph",
    "autopilot_active_time_s",
    "autopilot_active_distance_km",
    "autopilot_active_pct",
    *[f"{kind}_{what}" for kind in _KINDS for what in ("count", "per_100_km")],
    "total_events",
    "events_per_100_km",
)
_NOTABLE = ("events_per_100_km", *[f"{kind}_per_100_km" for kind in _KINDS], "max_speed_kph")


def _long(names: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"SELECT drive_id, start_time_us, {number} AS metric_no, '{name}' AS metric, "
        f"cast({name} AS double) AS value FROM metrics"
        for number, name in enumerate(names)
    )


_COMPARISON = f"""
long AS ({_long(_NUMBERS)}),
comparison AS (
  SELECT a.metric_no, a.metric, a.value AS left_value, b.value AS right_value,
         b.value - a.value AS difference,
         (b.value - a.value) / nullif(abs(a.value), 0) * 100.0 AS pct_difference
  FROM long a JOIN long b ON a.metric_no = b.metric_no
  WHERE a.drive_id = 'drive_0' AND b.drive_id = 'drive_7')"""

_TYPES = """
types AS (
  SELECT event_type, count(*) AS n, min((start_time_us, event_id)) AS first_seen
  FROM detected GROUP BY event_type),
worst AS (
  SELECT * FROM detected ORDER BY severity_score DESC, start_time_us, event_id LIMIT 1)"""


def _with(*parts: str, select: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + select


def _from_source(select: str) -> str:
    return _with(_SOURCE, select=select)


def _from_events(select: str, *more: str) -> str:
    return _with(_SOURCE, _INTERVALS, _EVENTS, *more, select=select)


def _from_metrics(select: str, *more: str) -> str:
    return _with(_SOURCE, _INTERVALS, _EVENTS, _METRICS, *more, select=select)


_CANONICAL = """
  source_file, drive_id, timestamp_us, elapsed_seconds, speed_kph, speed_mps, odometer_km,
  distance_delta_km, latitude, longitude, cast(NULL AS double) AS gps_accuracy_m,
  cast(NULL AS double) AS heading_deg, cast(NULL AS double) AS elevation_m,
  longitudinal_accel_mps2, lateral_accel_mps2, cast(NULL AS double) AS vertical_accel_mps2,
  steering_angle_deg, steering_rate_deg_s, cast(NULL AS double) AS accelerator_pct, brake_applied,
  autopilot_state, autopilot_state_code, cast(NULL AS varchar) AS acc_state,
  cast(NULL AS varchar) AS aeb_state, road_class, road_class_code, rainy, snowy, battery_soc_pct,
  cast(NULL AS double) AS battery_pack_current_a, cast(NULL AS double) AS battery_pack_voltage_v,
  cast(NULL AS double) AS lead_vehicle_distance_m, cast(NULL AS double) AS set_speed_kph,
  vehicles_detected"""

_COUNTERS = """
  (SELECT count(*) FROM coerced) AS rows_ingested,
  (SELECT count(*) FROM cleaned) AS rows_served,
  (SELECT count(*) FROM coerced WHERE epoch IS NULL) AS rows_dropped,
  (SELECT count(*) FROM valid) - (SELECT count(*) FROM firsts) AS duplicate_rows_removed"""


def oracle_sql() -> dict[str, str]:
    sql = {
        "drive_summary": _with(_SOURCE, _SUMMARY, select="SELECT * FROM summary"),
        "split_state": _from_source(
            """SELECT ord AS _pos,
              nullif(CASE WHEN contains(autopilot_txt, '|')
                THEN regexp_extract(autopilot_txt, '^(.*)[|]', 1) ELSE autopilot_txt END, '')
                AS autopilot_state,
              CASE WHEN contains(autopilot_txt, '|')
                THEN try_cast(regexp_extract(autopilot_txt, '[^|]*$') AS double) END
                AS autopilot_state_code,
              nullif(regexp_extract(road_txt, '^(.*)[|]', 1), '') AS road_class,
              try_cast(regexp_extract(road_txt, '[^|]*$') AS double) AS road_class_code
            FROM raw"""
        ),
        "truthy_state": _from_source(
            """SELECT ord AS _pos,
              coalesce((regexp_matches(lower(brake_txt), 'active|applying|on|true')
                  OR coalesce(try_cast(brake_txt AS double), 0) <> 0)
                AND NOT regexp_matches(lower(brake_txt),
                  'not_active|not_applying|inactive|off|false'), false) AS brake_applied,
              rainy_num <> 0 AS rainy, snowy_num <> 0 AS snowy
            FROM raw"""
        ),
        "elapsed_seconds": _from_source(
            """SELECT ord AS _pos, cast(epoch_ms(cast(elapsed_txt AS interval)) / 1000 AS double)
              AS elapsed_seconds FROM raw"""
        ),
        "numeric_coercion": _from_source(
            "SELECT ord AS _pos, epoch, speed_kph, odometer_km, latitude, vehicles FROM coerced"
        ),
        "drop_invalid_epoch": _from_source("SELECT drive_id, ord AS _pos FROM valid"),
        "dedup_keep_first": _from_source("SELECT drive_id, ord AS _pos, speed_kph FROM firsts"),
        "gps_clear": _from_source(
            "SELECT ord AS _pos, latitude, longitude, gps_bad AS cleared FROM cleaned"
        ),
        "quality_counts": _from_source(
            f"""SELECT *, concat(
                'Dropped ', format('{{:,}}', rows_dropped), ' rows with invalid timestamps.; ',
                'Removed ', format('{{:,}}', duplicate_rows_removed),
                ' duplicate telemetry samples.; ',
                'Cleared invalid GPS coordinates in ', format('{{:,}}', gps_rows_cleared), ' rows.')
                AS warnings
              FROM (SELECT {_COUNTERS},
                (SELECT count(*) FROM cleaned WHERE gps_bad) AS gps_rows_cleared)"""
        ),
        "distance_delta": _from_source(
            f"""SELECT drive_id, ord AS _pos, {_round("distance_delta_km", 6)} AS distance_delta_km
            FROM telemetry"""
        ),
        "canonical_telemetry": _from_source(f"SELECT {_CANONICAL} FROM telemetry"),
        "all_events": _from_events("SELECT * FROM detected"),
        "event_ordinals": _from_events(
            "SELECT event_id, event_type, drive_id, start_us AS start_time_us, ordinal FROM "
            "(SELECT kept.*, printf('%s:%s:%05d', drive_id, event_type, ordinal) AS event_id "
            "FROM kept)"
        ),
        "duration_weights": _with(
            _SOURCE,
            _INTERVALS,
            select="""SELECT drive_id, gap_us, count(*) AS samples,
              count(*) FILTER (is_active) AS active, max(weight_us) / 1000000e0 AS weight_s
            FROM weights GROUP BY drive_id, gap_us""",
        ),
        "sample_intervals": _with(
            _SOURCE,
            _INTERVALS,
            select="""SELECT drive_id, typical_us / 1000000e0 AS typical_interval_s,
              single_sample_counts FROM intervals""",
        ),
        "event_counts": _from_metrics("SELECT * FROM counts"),
        "drive_metrics": _from_metrics("SELECT * FROM metrics"),
        "fleet_metrics": _from_metrics("SELECT * FROM fleet"),
        "metric_summary": _from_metrics(
            f"""SELECT drives, {", ".join(_NUMBERS)} FROM fleet"""
        ),
        "ingest_summary": _from_source(
            f"""SELECT *, strftime(make_timestamp(a), '%Y-%m-%dT%H:%M:%S.%fZ') AS time_start,
                strftime(make_timestamp(b), '%Y-%m-%dT%H:%M:%S.%fZ') AS time_end,
                {_round("(b - a) / 1e6 / 60", 2)} AS duration_minutes
              FROM (SELECT {_COUNTERS}, {_round("sum(distance_delta_km)", 3)} AS distance_km,
                {_round("avg(speed_kph)", 2)} AS average_speed_kph,
                {_round("max(speed_kph)", 2)} AS max_speed_kph,
                count(DISTINCT drive_id) AS drives,
                min(timestamp_us) AS a, max(timestamp_us) AS b FROM telemetry)"""
        ).replace("SELECT *, strftime", "SELECT * EXCLUDE (a, b), strftime"),
        "telemetry_filter": _from_source(
            f"""SELECT {_CANONICAL} FROM telemetry
            WHERE autopilot_state = 'ACTIVE_NOMINAL' AND speed_kph >= 60"""
        ),
        "telemetry_first_rows": _from_source(
            f"""SELECT {_CANONICAL} FROM telemetry ORDER BY timestamp_us, source_file LIMIT 1000"""
        ),
        "telemetry_time_range": _from_source(
            """SELECT drive_id, timestamp_us, speed_kph FROM telemetry
            WHERE timestamp_us BETWEEN 1704067210000000 AND 1704067230000000"""
        ),
        "sample_records": _from_source(
            """SELECT drive_id, source_file, speed_kph, brake_applied,
              strftime(make_timestamp(timestamp_us), '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp
            FROM telemetry ORDER BY timestamp_us, source_file LIMIT 100"""
        ),
        "events_filter": _from_events(
            """SELECT * FROM detected
            WHERE event_type = 'sharp_steering' AND severity_score >= 0.5"""
        ),
        "events_first_rows": _from_events(
            "SELECT * FROM detected ORDER BY start_time_us, event_id LIMIT 1000"
        ),
        "drive_metrics_one": _from_metrics("SELECT * FROM metrics WHERE drive_id = 'drive_7'"),
        "drive_names": _from_metrics("SELECT DISTINCT drive_id FROM metrics"),
        "param_sql": _from_source(
            """SELECT road_class, count(*) AS samples, max(speed_kph) AS top_speed_kph
            FROM telemetry WHERE speed_kph >= 25 AND rainy = false GROUP BY road_class"""
        ),
        "drive_profile": _from_metrics(
            """SELECT s.drive_id, s.source_file, s.samples, s.start_time_us, s.end_time_us,
              s.autopilot_samples, m.* EXCLUDE (drive_id, source_file, start_time_us, end_time_us)
            FROM summary s JOIN metrics m USING (drive_id)""",
            _SUMMARY,
        ),
        "event_summary": _from_events(
            """SELECT cast(sum(n) AS bigint) AS total_events,
              string_agg(event_type || '=' || n, ',' ORDER BY n DESC, first_seen) AS event_counts,
              (SELECT severity_score FROM worst) AS max_severity_score,
              first(event_type ORDER BY n DESC, first_seen) AS most_common_event_type,
              (SELECT event_id FROM worst) AS highest_severity_event_id
            FROM types""",
            _TYPES,
        ),
        "compare_drives": _from_metrics("SELECT * FROM comparison", _COMPARISON),
        "comparison_findings": _from_metrics(
            """SELECT metric_no, 'comparison_' || metric AS name,
              format('{} was {:.1f}% {} in drive_7 than drive_0.', metric, abs(pct_difference),
                CASE WHEN difference > 0 THEN 'higher' ELSE 'lower' END) AS summary,
              pct_difference AS value,
              CASE WHEN abs(pct_difference) < 50 THEN 'medium' ELSE 'high' END AS severity
            FROM comparison WHERE abs(pct_difference) >= 10""",
            _COMPARISON,
        ),
        "trends": _from_metrics(
            f"""SELECT metric_no, metric, first_value, last_value,
              last_value - first_value AS absolute_change,
              (last_value - first_value) / nullif(abs(first_value), 0) * 100.0 AS change_pct,
              CASE WHEN abs(last_value - first_value)
                     <= greatest(abs(first_value), abs(last_value), 1.0) * 1e-9 THEN 'stable'
                   WHEN last_value > first_value THEN 'increasing' ELSE 'decreasing' END AS direction
            FROM (SELECT metric_no, metric,
                    first(value ORDER BY start_time_us, drive_id) AS first_value,
                    last(value ORDER BY start_time_us, drive_id) AS last_value
                  FROM ({_long(_NUMBERS)}) GROUP BY metric_no, metric HAVING count(value) >= 2)"""
        ),
        "notable_metrics": _from_metrics(
            f"""SELECT drive_id, metric_no, metric, value, {_round("threshold", 6)} AS threshold,
              {_round("rank", 2)} AS percentile_rank, 'high' AS direction,
              CASE WHEN rank >= 99 OR rank <= 1 THEN 'high' ELSE 'medium' END AS severity,
              0.95e0 AS comparison_percentile
            FROM (SELECT *, cume_dist() OVER (PARTITION BY metric ORDER BY value) * 100 AS rank,
                    quantile_cont(value, 0.95) OVER (PARTITION BY metric) AS threshold
                  FROM ({_long(_NOTABLE)}))
            WHERE value >= threshold"""
        ),
        "event_insights": _from_events(
            """SELECT 0 AS position, 'most_common_event' AS name,
              format('{} was the most common detected event ({}).', event_type, n) AS summary,
              'info' AS severity
            FROM (SELECT * FROM types ORDER BY n DESC, first_seen LIMIT 1)
            UNION ALL
            SELECT 1, 'highest_severity_event',
              format('The highest-severity event was {} with severity {:.2f}.',
                event_type, severity_score), 'high'
            FROM worst""",
            _TYPES,
        ),
        "busiest_drive": _from_metrics(
            """SELECT 'highest_event_rate_drive' AS name,
              format('Drive {} had the highest detected-event rate at {:.2f} per 100 km.',
                drive_id, events_per_100_km) AS summary,
              'medium' AS severity
            FROM metrics ORDER BY events_per_100_km DESC, start_time_us, drive_id LIMIT 1"""
        ),
        # Logs of drives with an odd number have no road class.
        "ingest_csv": _from_source(
            f"""SELECT {_CANONICAL} FROM (
              SELECT * REPLACE (
                CASE WHEN cast(drive_id[7:] AS bigint) % 2 = 0 THEN road_class END AS road_class,
                CASE WHEN cast(drive_id[7:] AS bigint) % 2 = 0 THEN road_class_code END
                  AS road_class_code)
              FROM telemetry)"""
        ),
        "client_events": _from_events("SELECT * FROM detected"),
        "client_drives": _with(_SOURCE, _SUMMARY, select="SELECT * FROM summary"),
        "client_projection": _from_source(
            """SELECT drive_id, timestamp_us, speed_kph FROM telemetry
            WHERE drive_id = 'drive_0' AND timestamp_us <= 1704088800000000"""
        ),
        "client_metric": _from_metrics(
            """SELECT cast((SELECT total_events FROM fleet) AS bigint) AS fleet_events,
              (SELECT max_speed_kph FROM metrics WHERE drive_id = 'drive_7') AS top_speed_kph"""
        ),
        "client_summary": _from_metrics(
            """SELECT s.drive_id, s.source_file, s.samples, s.start_time_us, s.end_time_us,
              s.autopilot_samples, m.* EXCLUDE (drive_id, source_file, start_time_us, end_time_us)
            FROM summary s JOIN metrics m USING (drive_id) WHERE s.drive_id = 'drive_7'""",
            _SUMMARY,
        ),
        "export_events": _from_events("SELECT * FROM detected"),
        "export_metrics": _from_metrics("SELECT * FROM metrics"),
        "run_history": _from_source(
            f"""SELECT id, files_processed, rows_ingested, rows_served, rows_dropped,
              duplicate_rows_removed
            FROM (SELECT {_COUNTERS},
                (SELECT count(DISTINCT source_file) FROM coerced) AS files_processed),
              (SELECT unnest([1, 2]::bigint[]) AS id)"""
        ),
        "fleet_event_totals": _from_events(
            "SELECT count(*) AS events, count(*) AS metric_events FROM detected"
        ),
    }
    for kind in _KINDS:
        sql[kind] = _from_events(f"SELECT * FROM detected WHERE event_type = '{kind}'")
    return sql
