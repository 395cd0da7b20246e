import csv
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from checks import registry
from wheeltrace.operators.canonical import add_distance_delta, to_telemetry
from wheeltrace.operators.cleaning import clean, coerce_columns, quality_counts
from wheeltrace.plans.ingest import compute_metrics, ingest_folder, summarize_ingest
from wheeltrace.schemas import REQUIRED_SOURCE_COLUMNS, TELEMETRY_COLUMNS
from wheeltrace.plans import ingest
from wheeltrace.sources import csv_logs
from wheeltrace.sources.csv_logs import discover_csv_files, read_csv_logs
from wheeltrace.sources.store import TelemetryStore

EPOCH = 1704067200
T0 = datetime(2024, 1, 1)


def source_row(second, **values):
    row = {name: "1" for name in REQUIRED_SOURCE_COLUMNS}
    row["Time (epoch)"] = str(EPOCH + second)
    row["veh_odometer (km)"] = str(100 + second)
    row["DAS_autopilotState"] = "ACTIVE_NOMINAL|3"
    row.update(values)
    return row


def write_log(folder, name, rows, columns=None):
    folder.mkdir(exist_ok=True, parents=True)
    columns = columns or list(rows[0])
    with open(folder / name, "w", newline="", encoding="utf-8") as handle:
        writer = csv.DictWriter(handle, columns, extrasaction="ignore")
        writer.writeheader()
        writer.writerows(rows)


def run(spark, folder, tmp_path):
    store = TelemetryStore(spark, tmp_path / "store")
    return ingest_folder(spark, str(folder), store), store


def test_dirty_logs_end_to_end(spark, tmp_path):
    logs = tmp_path / "logs"
    write_log(
        logs,
        "a.csv",
        [
            source_row(0),
            source_row(1, **{"veh_speed (kph)": "n/a"}),
            source_row(1, **{"veh_speed (kph)": "77"}),
            source_row(2, **{"Time (epoch)": "bad"}),
            source_row(3, **{"gps_latitude (deg)": "123.5"}),
            source_row(4, **{"gps_longitude (deg)": "-200", "veh_odometer (km)": "90"}),
            source_row(5, **{"veh_speed (kph)": "1d", "gps_latitude (deg)": "90"}),
        ],
    )
    write_log(logs, "b.csv", [source_row(1), source_row(9)])
    result, store = run(spark, logs, tmp_path)
    assert result.warnings == (
        "Dropped 1 rows with invalid timestamps.",
        "Removed 1 duplicate telemetry samples.",
        "Cleared invalid GPS coordinates in 2 rows.",
    )
    counters = (9, 7, 1, 1)
    assert counters == (
        result.rows_ingested,
        result.rows_served,
        result.rows_dropped,
        result.duplicate_rows_removed,
    )
    rows = store.telemetry().where("drive_id = 'a'").orderBy("timestamp").collect()
    assert [r.speed_kph for r in rows] == [1.0, None, 1.0, 1.0, None]
    assert [r.latitude for r in rows] == [1.0, 1.0, None, None, 90.0]
    assert [r.distance_delta_km for r in rows] == [None, 1.0, 2.0, 0.0, 15.0]
    assert rows[0].source_file == "a.csv" and rows[0].autopilot_state_code == 3.0
    assert store.telemetry().columns == list(TELEMETRY_COLUMNS)

    summary = summarize_ingest(result).first()
    assert (summary.files_processed, summary.drives, summary.distance_km) == (2, 2, 26.0)
    assert summary.time_start == "2024-01-01T00:00:00.000000Z"
    assert summary.duration_minutes == 0.15

    ingest_folder(spark, str(logs), store)
    history = store.ingestion_runs().orderBy("id").collect()
    assert [(run.id, run.files_processed, run.rows_served) for run in history] == [
        (1, 2, 7),
        (2, 2, 7),
    ]
    assert history[0].loaded_at is not None


def test_headers_may_differ(spark, tmp_path):
    logs = tmp_path / "logs"
    names = list(REQUIRED_SOURCE_COLUMNS)
    write_log(logs, "plain.csv", [source_row(0, **{"veh_speed (kph)": "10"})], names)
    write_log(logs, "mixed.csv", [source_row(0, **{"veh_speed (kph)": "20"})], names[::-1])
    write_log(
        logs,
        "short.csv",
        [source_row(0, **{"UI_roadClass": "HIGHWAY|1", "Extra": "x,y", "Time_Elapsed": "00:01:00"})],
        [*[n for n in names if n != "veh_speed (kph)"], "UI_roadClass", "Extra", "Time_Elapsed"],
    )
    result, store = run(spark, logs, tmp_path)
    rows = {r.drive_id: r for r in store.telemetry().collect()}
    assert rows["plain"].speed_kph == 10.0 and rows["mixed"].speed_kph == 20.0
    assert rows["short"].speed_kph is None and rows["short"].road_class == "HIGHWAY"
    assert rows["short"].elapsed_seconds == 60.0 and rows["plain"].road_class is None
    assert result.files_processed == 3


def test_required_column_missing_everywhere(spark, tmp_path):
    logs = tmp_path / "logs"
    names = [n for n in REQUIRED_SOURCE_COLUMNS if n not in ("# Vehicles", "BMS_socAvg (per)")]
    write_log(logs, "a.csv", [source_row(0)], names)
    with pytest.raises(ValueError, match="required columns: # Vehicles, BMS_socAvg"):
        run(spark, logs, tmp_path)


def test_odd_names_and_neighbours(spark, tmp_path):
    logs = tmp_path / "my logs"
    for name in ("a b.csv", "c+d.csv", "e%20f.csv", "g[1].csv", "dots.v2.csv"):
        write_log(logs, name, [source_row(0), source_row(1)])
    write_log(logs, "note.txt", [source_row(0)])
    write_log(logs / "sub", "inner.csv", [source_row(0)])
    files = discover_csv_files(spark, str(logs)).orderBy("source_file").collect()
    names = ["a b.csv", "c+d.csv", "dots.v2.csv", "e%20f.csv", "g[1].csv"]
    assert [f.source_file for f in files] == names
    _, store = run(spark, logs, tmp_path)
    drives = store.telemetry().groupBy("drive_id").count().orderBy("drive_id").collect()
    assert [(d.drive_id, d["count"]) for d in drives] == [(n[:-4], 2) for n in names]


def test_no_files(spark, tmp_path):
    for folder in (tmp_path / "absent", tmp_path / "empty"):
        if folder.name == "empty":
            folder.mkdir()
        result, store = run(spark, folder, tmp_path)
        assert result.warnings == (f"No CSV files found in {folder}.",)
        assert result.telemetry.count() == 0 and store.ingestion_runs().count() == 0
        summary = summarize_ingest(result).first()
        assert (summary.drives, summary.duration_minutes, summary.time_start) == (0, 0.0, None)


def test_folders_written_with_dots(spark, tmp_path):
    logs = tmp_path / "logs"
    write_log(logs, "a.csv", [source_row(0)])
    for name in (f"{logs}/.", f"{logs}/../logs/", str(logs)):
        assert discover_csv_files(spark, name).count() == 1


def test_hidden_names_are_refused(spark, tmp_path):
    logs = tmp_path / "logs"
    write_log(logs, "a.csv", [source_row(0)])
    write_log(logs, "_b.csv", [source_row(0)])
    with pytest.raises(ValueError, match="_b.csv"):
        discover_csv_files(spark, str(logs))


def test_blank_lines_before_the_header(spark, tmp_path):
    logs = tmp_path / "logs"
    write_log(logs, "a.csv", [source_row(0), source_row(1)])
    text = (logs / "a.csv").read_text()
    (logs / "a.csv").write_text("\n\n" + text)
    rows = read_csv_logs(spark, str(logs))
    assert rows.count() == 2
    assert rows.where("`veh_speed (kph)` IS NULL").count() == 0


def test_header_only_file(spark, tmp_path):
    logs = tmp_path / "logs"
    write_log(logs, "a.csv", [], ["Time (epoch)"])
    result, _ = run(spark, logs, tmp_path)
    assert (result.files_processed, result.rows_served) == (1, 0)


def test_one_scan_for_any_headers(spark, tmp_path, monkeypatch):
    """Permuted, wider, narrower and repeated columns, a byte order mark, long and short rows."""
    logs = tmp_path / "logs"
    names = list(REQUIRED_SOURCE_COLUMNS)
    speed = "veh_speed (kph)"
    for n in range(12):
        order = names[n:] + names[:n]
        if n % 3 == 1:
            order = ["Unknown", *order, "", "", "UI_roadClass", "More"]
        if n % 3 == 2:
            order = [name for name in order if name != "BMS_socAvg (per)"]
        extra = {speed: str(n), "UI_roadClass": f"R{n}|1", "More": 'quoted, "text"'}
        write_log(logs, f"log{n:02}.csv", [source_row(k, **extra) for k in range(3)], order)
    text = (logs / "log04.csv").read_text()
    (logs / "log04.csv").write_text("\ufeff" + text)
    (logs / "empty.csv").write_text("")
    (logs / "odd.csv").write_text(
        ",".join([speed, *names]) + "\n" + ",".join(["9", *["1"] * 20]) + "\n5\n\n"
    )
    scans = []
    scan = csv_logs.scan_positions
    monkeypatch.setattr(
        csv_logs, "scan_positions", lambda *given: scans.append(1) or scan(*given)
    )
    monkeypatch.setattr(csv_logs, "BROADCAST_FILES", 3)
    rows = read_csv_logs(spark, str(logs)).collect()
    assert len(scans) == 1
    by_drive = {}
    for row in rows:
        by_drive.setdefault(row.drive_id, []).append(row)
    for n in range(12):
        own = by_drive.pop(f"log{n:02}")
        assert [row[speed] for row in own] == [str(n)] * 3
        assert sorted(row["Time (epoch)"] for row in own) == [str(EPOCH + k) for k in range(3)]
        assert {row["UI_roadClass"] for row in own} == {f"R{n}|1" if n % 3 == 1 else None}
        assert {row["BMS_socAvg (per)"] for row in own} == {None if n % 3 == 2 else "1"}
    # The first of two equal names counts; a short row has missing values.
    assert sorted(row[speed] for row in by_drive.pop("odd")) == ["5", "9"]
    assert by_drive == {}


def test_other_schemes(spark, tmp_path):
    """A path that only Hadoop's file systems resolve."""
    logs = tmp_path / "my logs"
    write_log(logs, "a b.csv", [source_row(0), source_row(1)])
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("fs.viewfs.mounttable.logs.link./in", f"file://{tmp_path}")
    rows = read_csv_logs(spark, "viewfs://logs/in/my logs")
    assert [row.drive_id for row in rows.collect()] == ["a b", "a b"]


def test_raw_rows_are_shuffled_once(spark, tmp_path):
    logs = tmp_path / "logs"
    write_log(logs, "a.csv", [source_row(0), source_row(1)])
    cleaned = clean(coerce_columns(read_csv_logs(spark, str(logs))))
    plan = cleaned._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_long_stages_are_compiled(spark, tmp_path):
    """Methods above 8,000 bytes are interpreted; such stages generate code by operator."""
    logs = tmp_path / "logs"
    write_log(logs, "a.csv", [source_row(0), source_row(1)])
    name = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.unset(name)
    rows = read_csv_logs(spark, str(logs))
    assert int(spark.conf.get(name)) <= 8000
    assert rows.count() == 2


def test_ingest_lists_the_folder_twice(spark, tmp_path, monkeypatch):
    """Once for the files, once for their lines."""
    logs = tmp_path / "logs"
    write_log(logs, "a.csv", [source_row(0), source_row(1)])
    listings = []
    for module, name in (
        (ingest, "discover_csv_files"),
        (csv_logs, "discover_csv_files"),
        (csv_logs, "_text_lines"),
    ):
        listed = getattr(module, name)
        monkeypatch.setattr(
            module, name, lambda *given, listed=listed: listings.append(1) or listed(*given)
        )
    result, _ = run(spark, logs, tmp_path)
    assert (result.rows_ingested, len(listings)) == (2, 2)


def test_blank_lines_and_control_characters(spark, tmp_path):
    """Lines of white space and control characters are blank, also before the header."""
    logs = tmp_path / "logs"
    write_log(logs, "a.csv", [source_row(0), source_row(1)])
    text = (logs / "a.csv").read_text()
    (logs / "a.csv").write_text("\t \n\n" + text + " \x01\t\n\n")
    assert read_csv_logs(spark, str(logs)).count() == 2


def test_header_without_rows(spark, tmp_path):
    logs = tmp_path / "logs"
    write_log(logs, "a.csv", [], list(REQUIRED_SOURCE_COLUMNS))
    result, _ = run(spark, logs, tmp_path)
    assert (result.files_processed, result.rows_ingested, result.rows_served) == (1, 0, 0)
    assert result.warnings == ()


def test_split_file_keeps_its_order(spark, tmp_path):
    """Distances across the pieces of a file that is read in many splits."""
    logs = tmp_path / "logs"
    write_log(logs, "big.csv", [source_row(i, **{"veh_odometer (km)": str(i * i)}) for i in range(900)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = read_csv_logs(spark, str(logs))
        assert rows.select("_chunk").distinct().count() > 5
        _, store = run(spark, logs, tmp_path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    steps = store.telemetry().orderBy("timestamp").collect()
    assert [s.distance_delta_km for s in steps] == [None, *[2.0 * i + 1 for i in range(899)]]


def raw_frame(spark, rows):
    """Rows as (chunk, position, row of source values)."""
    names = list(REQUIRED_SOURCE_COLUMNS)
    data = [("d.csv", "d", c, p, *[row.get(n) for n in names]) for c, p, row in rows]
    schema = "source_file string, drive_id string, _chunk bigint, _pos bigint, " + ", ".join(
        f"`{n}` string" for n in names
    )
    return spark.createDataFrame(data, schema)


def test_distance_across_chunks_and_gaps(spark):
    readings = [(0, 1, "5"), (0, 2, "7"), (10, 3, None), (20, 4, "9"), (20, 5, "8"), (40, 6, "10")]
    rows = [
        (chunk, pos, source_row(pos, **{"veh_odometer (km)": reading}))
        for chunk, pos, reading in reversed(readings)
    ]
    stepped = add_distance_delta(clean(coerce_columns(raw_frame(spark, rows)))).orderBy("_pos")
    steps = [row.distance_delta_km for row in stepped.collect()]
    assert steps == [None, 2.0, None, None, 0.0, 2.0]


def test_first_copy_wins_wherever_it_is(spark):
    rows = [
        (chunk, pos, source_row(0, **{"veh_speed (kph)": str(pos)}))
        for chunk in (0, 1, 2)
        for pos in range(chunk * 50, chunk * 50 + 50)
    ]
    kept = clean(coerce_columns(raw_frame(spark, rows[::-1])))
    assert [row._pos for row in kept.collect()] == [0]
    counts = quality_counts(coerce_columns(raw_frame(spark, rows))).first()
    assert (counts.rows_served, counts.duplicate_rows_removed) == (1, 149)
    assert counts.warnings == ["Removed 149 duplicate telemetry samples."]


def test_copies_are_limited_before_the_shuffle(spark):
    frame = coerce_columns(raw_frame(spark, [(0, 0, source_row(0))]))
    plan = clean(frame)._jdf.queryExecution().executedPlan().toString()
    exchange = plan.index("Exchange hashpartitioning(source_file")
    assert "Partial" in plan[exchange:]


def test_unused_distance_is_not_computed(spark):
    frame = to_telemetry(clean(coerce_columns(raw_frame(spark, [(0, 0, source_row(0))]))))
    plan = frame.select("drive_id", "speed_kph")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_compute_metrics_persists(spark, tmp_path):
    logs = tmp_path / "logs"
    strong = {"RCM_lateralAccel (m/s^2)": "3.5"}
    write_log(logs, "a.csv", [source_row(i * 0.4, **strong) for i in range(5)])
    result, store = run(spark, logs, tmp_path)
    computed = compute_metrics(store)
    assert store.events().count() == computed.events.count() == 1
    assert store.drive_metrics().first().high_lateral_accel_count == 1
    assert computed.fleet_metrics.first().total_events == 1
    loose = compute_metrics(TelemetryStore(spark, tmp_path / "other"), result.telemetry, False)
    assert loose.drive_metrics.first() == store.drive_metrics().first()
    empty = compute_metrics(TelemetryStore(spark, tmp_path / "none"))
    assert empty.events.count() == 0 and empty.fleet_metrics.first().drives == 0


def test_timestamps_are_utc(spark, tmp_path):
    logs = tmp_path / "logs"
    write_log(logs, "a.csv", [source_row(0.25)])
    _, store = run(spark, logs, tmp_path)
    row = store.telemetry().select(F.unix_micros("timestamp").alias("us")).first()
    assert row.us == EPOCH * 1_000_000 + 250_000


def test_odd_lines_are_parsed_once_and_headers_joined_once(spark, tmp_path):
    """A plan that parses a raw line for every cell, or joins heads and places apart, is slow."""
    logs = tmp_path / "logs"
    write_log(logs, "a.csv", [source_row(0), source_row(1)])
    fewer = [name for name in list(source_row(0))[::-1] if name != "UI_roadClass"]
    write_log(logs, "b.csv", [source_row(k, More="x") for k in range(2)], ["More", *fewer])
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        rows = coerce_columns(read_csv_logs(spark, str(logs)))
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    # Once for the lines, once for their headers.
    assert plan.count("from_csv(") == 2
    assert plan.count("Join ") == 1
    assert {(row.drive_id, row["Time (epoch)"] - EPOCH) for row in rows.collect()} == {
        ("a", 0.0), ("a", 1.0), ("b", 0.0), ("b", 1.0)
    }


def test_logs_get_their_names_without_being_moved(spark, tmp_path):
    """The derived logs: one file per drive, nothing staged, rows in order, two headers."""
    events = [(2, 10, "view"), (1, 10, "click"), (4, 11, None), (3, 11, "view"), (5, None, "view")]
    spark.createDataFrame(
        [(n, T0, user, kind, 1.5, '{"k": 7}') for n, user, kind in events],
        "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    ).write.parquet(str(tmp_path / "events.parquet"))
    logs = Path(registry._write_logs(spark, str(tmp_path)).removeprefix("file:"))
    assert sorted(path.name for path in logs.iterdir()) == ["drive_10.csv", "drive_11.csv"]
    assert not list(logs.parent.glob("staged-*"))
    even, odd = ([*csv.reader(open(logs / f"drive_{n}.csv"))] for n in (10, 11))
    assert odd[0] == [name for name in even[0][::-1] if name != "UI_roadClass"]
    place = even[0].index("veh_odometer (km)")
    # Event 1 has a copy of its sample.
    assert [row[place] for row in even[1:]] == ["0.51", "0.51", "1.02"]
    assert len(odd) == 3


def test_short_logs_share_tasks_and_the_listing_is_not_kept(spark, tmp_path):
    """Hundreds of logs are read by a few tasks; the result's files are a written table."""
    spark.conf.set("spark.sql.files.openCostInBytes", str(4 << 20))
    for k in range(200):
        (tmp_path / f"d{k:03d}.csv").write_text("Time (epoch)\n1\n")
    text = csv_logs._text_lines(spark, str(tmp_path))
    assert text.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism + 1
    assert int(spark.conf.get("spark.sql.files.openCostInBytes")) == csv_logs.LOG_OPEN_BYTES
    folder = tmp_path / "one"
    write_log(folder, "e.csv", [source_row(0)])
    size = (folder / "e.csv").stat().st_size
    result = ingest.ingest_folder(spark, str(folder), TelemetryStore(spark, str(tmp_path / "store")))
    (folder / "e.csv").unlink()
    assert [(row.source_file, row.bytes) for row in result.files.collect()] == [("e.csv", size)]
    assert result.files_processed == 1
