import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wheeltrace.operators.insights import (
    analyze_trends,
    compare_metrics,
    find_notable_metrics,
    summarize_events,
    summarize_metrics,
)
from wheeltrace.operators.scale import running_total, salted_join


def drives(spark, values, name="max_speed_kph"):
    rows = [(f"d{i:03d}", value) for i, value in enumerate(values)]
    return spark.createDataFrame(rows, f"drive_id string, {name} double")


@pytest.mark.parametrize("percentile", [0.51, 0.9, 0.95])
def test_notable_matches_numpy(spark, percentile):
    chance = random.Random(5)
    # A third of the drives share one value.
    values = [chance.choice([10.0, float(chance.randint(0, 60))]) for _ in range(151)]
    found = find_notable_metrics(drives(spark, values), percentile=percentile).collect()
    limit = np.percentile(values, percentile * 100)
    assert sorted(row.drive_id for row in found) == sorted(
        f"d{i:03d}" for i, value in enumerate(values) if value >= limit
    )
    for row in found:
        assert row.threshold == pytest.approx(limit)
        share = np.mean([value <= row.value for value in values]) * 100
        assert row.percentile_rank == round(share, 2)
        assert row.severity == ("high" if share >= 99 else "medium")


def test_ranks_are_computed_once_and_looked_up_after_the_threshold(spark):
    frame = drives(spark, [float(i % 7) for i in range(40)] + [99.0])
    found = find_notable_metrics(frame)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Expand" not in plan
    assert "sequence(" not in plan
    assert {row.value for row in found.collect()} >= {99.0}


def test_equal_drives_are_all_notable(spark):
    found = find_notable_metrics(drives(spark, [0.0] * 5))
    assert [(r.percentile_rank, r.severity) for r in found.collect()] == [(100.0, "high")] * 5


def test_low_values_can_be_notable(spark):
    frame = drives(spark, [1.0, 50.0, 60.0, 70.0, None], "autopilot_active_pct")
    (row,) = find_notable_metrics(frame, metric_names=["autopilot_active_pct", "nope"]).collect()
    assert (row.drive_id, row.direction, row.percentile_rank) == ("d000", "low", 25.0)


def test_small_population_is_not_judged(spark):
    assert find_notable_metrics(drives(spark, [1.0, 2.0, None])).count() == 0
    for percentile in (0.5, 1.0):
        with pytest.raises(ValueError, match="percentile"):
            find_notable_metrics(drives(spark, [1.0]), percentile=percentile)


def test_one_drive_of_many(spark):
    frame = drives(spark, [float(i) for i in range(40)])
    assert [r.drive_id for r in find_notable_metrics(frame, "d039").collect()] == ["d039"]
    assert find_notable_metrics(frame, "d000").count() == 0


def test_compare(spark):
    left = spark.createDataFrame([("a", 0.0, 4.0, None, "x")], "drive_id string, p double, q double, r double, s string")
    right = spark.createDataFrame([("b", 2, 3.0, 1.0, "y")], "drive_id string, p bigint, q double, r double, s string")
    rows = compare_metrics(left, right).orderBy("metric_no").collect()
    assert [(r.metric, r.difference, r.pct_difference) for r in rows] == [
        ("p", 2.0, None),
        ("q", -1.0, -25.0),
    ]
    assert compare_metrics(left, right, ["nope"]).count() == 0


def test_trends(spark):
    rows = [
        ("c", "2024-01-03 00:00:00", 5.0, 1.0, None),
        ("a", "2024-01-01 00:00:00", None, 1.0, 7.0),
        ("b", "2024-01-02 00:00:00", 4.0, 1.0 + 1e-10, None),
        ("z", None, 2.0, 1.0, None),
    ]
    frame = spark.createDataFrame(rows, "drive_id string, start_time string, x double, y double, w double")
    got = {r.metric: r for r in analyze_trends(frame).collect()}
    assert set(got) == {"x", "y"}
    assert (got["x"].first_value, got["x"].last_value) == (4.0, 2.0)
    assert (got["x"].change_pct, got["x"].direction) == (-50.0, "decreasing")
    assert got["y"].direction == "stable"
    assert analyze_trends(frame.limit(1)).count() == 0


def event_rows(spark, rows):
    schema = "event_id string, event_type string, start_time string, severity_score double"
    frame = spark.createDataFrame(rows, schema)
    return frame.withColumn("start_time", F.col("start_time").cast("timestamp"))


def test_event_summary_ties(spark):
    rows = [
        ("2", "late", "2024-01-01 00:00:09", 0.9),
        ("1", "early", "2024-01-01 00:00:01", 0.9),
        ("3", "late", "2024-01-01 00:00:10", None),
        ("4", "early", "2024-01-01 00:00:11", 0.1),
        ("5", "rare", "2024-01-01 00:00:00", 0.2),
    ]
    got = summarize_events(event_rows(spark, rows)).select(
        "*", F.map_entries("event_counts").alias("counts")
    ).first()
    assert got.total_events == 5 and got.max_severity_score == 0.9
    assert [tuple(entry) for entry in got.counts] == [("early", 2), ("late", 2), ("rare", 1)]
    assert got.most_common_event_type == "early"
    assert got.highest_severity_event.event_id == "1"


def test_event_summary_without_scores(spark):
    got = summarize_events(event_rows(spark, [("1", "t", "2024-01-01 00:00:00", None)])).first()
    assert (got.total_events, got.max_severity_score) == (1, 0.0)
    assert got.highest_severity_event is None


def test_metric_summary(spark):
    frame = spark.createDataFrame([("d", 1.0, "x")], "drive_id string, duration_s double, z string")
    assert summarize_metrics(frame).columns == ["drive_id", "duration_s"]
    assert summarize_metrics(frame.limit(0)).count() == 0
    with pytest.raises(ValueError, match="exactly one"):
        summarize_metrics(frame.union(frame))


def test_running_total_is_exact_across_slices(spark):
    frame = spark.range(1000).selectExpr(
        "CASE WHEN id % 10 < 8 THEN 'hot' ELSE concat('g', id % 10) END AS g", "id AS at", "id % 7 AS n"
    )
    got = running_total(frame, ["g"], ["at"], F.col("n"), "upto").collect()
    sums = {}
    for row in sorted(got, key=lambda r: (r.g, r.at)):
        sums[row.g] = sums.get(row.g, 0) + row.n
        assert row.upto == sums[row.g]
    assert len(got) == 1000


def test_salted_join_equals_join(spark):
    facts = spark.range(500).selectExpr("CASE WHEN id < 400 THEN 'hot' ELSE cast(id AS string) END AS k", "id")
    lookup = spark.createDataFrame([("hot", 1), ("450", 2)], "k string, v int")
    got = salted_join(facts, lookup, ["k"], ["id"])
    plain = facts.join(lookup, "k", "left").select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    assert salted_join(facts, lookup, ["k"], ["id"], "inner").count() == 401


def test_lookups_that_grow_are_not_broadcast(spark, tmp_path):
    """Few bytes on disk, and 32 times the rows once copied: Spark's estimate sees the bytes."""
    path = str(tmp_path / "lookup")
    spark.range(40_000).selectExpr("concat('drive_', id) AS k", "id % 2 = 0 AS v").write.parquet(path)
    facts = spark.range(300).selectExpr("concat('drive_', id * 7) AS k", "id")
    got = salted_join(facts, spark.read.parquet(path), ["k"], ["id"])
    assert got.where("v = (id * 7 % 2 = 0)").count() == 300
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
