import random
from statistics import median

from pyspark.sql import functions as F

from helpers import sample, telemetry_frame
from wheeltrace.config import MAX_SAMPLE_GAP_US
from wheeltrace.operators.samples import drive_intervals, prepare_samples, weighted_medians


def test_against_plain_medians(spark):
    rng = random.Random(5)
    held = {
        "one": [(7, 1)],
        "even": [(4, 1), (5_000_001, 1)],
        "tie": [(2047, 3), (2048, 3)],
        "none": [(9, 0)],
        "hot": [(rng.randrange(5_000_000), rng.randint(0, 4)) for _ in range(20_000)],
    }
    for n in range(30):
        held[f"d{n}"] = [(rng.randrange(10**rng.randint(1, 6)), rng.randint(0, 9)) for _ in range(n + 1)]
    rows = [(key, value, weight) for key, own in held.items() for value, weight in own]
    frame = spark.createDataFrame(rows, "drive_id string, value bigint, weight bigint")
    found = {row.drive_id: row.median for row in weighted_medians(frame, ["drive_id"]).collect()}
    for key, own in held.items():
        spread = [value for value, weight in own for _ in range(weight)]
        assert found.get(key) == (float(median(spread)) if spread else None), key


def test_no_task_holds_the_values_of_a_drive(spark):
    """Neither value maps nor a drive's distinct pauses: only cells and values of one cell."""
    frame = telemetry_frame(spark, [sample("a", k * 400_000) for k in range(9)])
    intervals = drive_intervals(prepare_samples(frame))
    plan = intervals._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect_" not in plan
    row = intervals.first()
    assert (row.typical_interval_s, row.single_sample_counts) == (0.4, True)


def test_hot_drive_is_spread(spark):
    """One drive with a third of all pauses: rows that meet in one task stay few."""
    values = spark.range(200_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot"))
        .otherwise(F.concat(F.lit("d"), (F.col("id") % 500).cast("string")))
        .alias("drive_id"),
        (F.pmod(F.xxhash64("id"), F.lit(MAX_SAMPLE_GAP_US))).alias("value"),
        F.lit(1).cast("bigint").alias("weight"),
    )
    cells = values.select("drive_id", F.expr("value div 2048").alias("cell"), "value").distinct()
    per_key = cells.select("drive_id", "cell").distinct().groupBy("drive_id").count()
    per_cell = cells.groupBy("drive_id", "cell").count()
    assert per_key.agg(F.max("count")).first()[0] <= 2442
    assert per_cell.agg(F.max("count")).first()[0] <= 2048
    expected = values.groupBy("drive_id").agg(F.percentile("value", 0.5).alias("median"))
    assert weighted_medians(values, ["drive_id"]).exceptAll(expected).count() == 0
