"""Normalised samples and the intervals between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wheeltrace.config import (
    FINE_CELL_US,
    MAX_SAMPLE_GAP_US,
    MIN_EVENT_DURATION_US,
    SECOND_US,
)
from wheeltrace.functions.scalars import autopilot_active, cell_start, to_number
from wheeltrace.operators.scale import materialize

MEASURES = (
    "speed_kph",
    "distance_delta_km",
    "longitudinal_accel_mps2",
    "lateral_accel_mps2",
    "steering_rate_deg_s",
)
# Pauses up to the sampling limit fall into cells of this width: about as many cells as there
# are values in one.
MEDIAN_CELL = 2048

# Columns the metrics cannot do without.
REQUIRED_TELEMETRY = ("drive_id", "timestamp", *MEASURES, "autopilot_state")


def prepare_samples(telemetry: DataFrame, extra_measures: tuple[str, ...] = ()) -> DataFrame:
    """Typed samples with a drive and a time; adds `moment_us` and `is_active`.

    Optional columns that are absent come out as NULL (texts) or false (flags).
    Samples of a drive at the same microsecond have no order of their own; where
    one must come first, their values decide.
    """
    types = {field.name: field.dataType for field in telemetry.schema}
    measures = [*MEASURES, *[name for name in extra_measures if name not in MEASURES]]
    missing = sorted({*REQUIRED_TELEMETRY, *measures} - set(types))
    if missing:
        raise ValueError("Metrics require canonical telemetry columns: " + ", ".join(missing))

    def text(name: str):
        return F.col(name) if name in types else F.lit(None).cast("string")

    def flag(name: str):
        return F.coalesce(F.col(name), F.lit(False)) if name in types else F.lit(False)

    if isinstance(types["timestamp"], T.StringType):
        moment = F.col("timestamp").try_cast("timestamp")
    else:
        moment = F.col("timestamp").cast("timestamp")
    return telemetry.select(
        F.col("drive_id").cast("string").alias("drive_id"),
        text("source_file").alias("source_file"),
        F.unix_micros(moment).alias("moment_us"),
        *[to_number(F.col(name), types[name]).alias(name) for name in measures],
        autopilot_active(F.col("autopilot_state").cast("string")).alias("is_active"),
        text("road_class").alias("road_class"),
        flag("rainy").alias("rainy"),
        flag("snowy").alias("snowy"),
    ).where(F.col("drive_id").isNotNull() & F.col("moment_us").isNotNull())


def sample_intervals(
    samples: DataFrame, cell_us: int = FINE_CELL_US, combine_copies: bool = True
) -> DataFrame:
    """How often each pause between neighbouring samples occurs, per drive.

    One row per drive and pause (`gap_us`) with the number of samples it follows
    (`samples`) and how many of those were active (`active`). `gap_us` is NULL
    for samples with no other sample within the sampling limit after them, the
    last of the drive among them. Rows are bounded by the distinct pauses up to
    the limit, whatever the number of samples.

    Neighbours are found inside fixed time cells. The first seconds of a cell
    are repeated at the end of the cell before, which is enough to see every
    pause up to the limit; longer ones are all alike.

    `combine_copies` merges samples of one instant before the cells are formed,
    so that many copies of a sample never meet in one task. It changes no result.
    For ingested telemetry, where repeated samples are already gone, leaving it
    out saves a shuffle of the table.
    """
    if cell_us < MAX_SAMPLE_GAP_US:
        raise ValueError("a cell must be at least as long as the largest pause")
    active = F.col("is_active").cast("bigint")
    if combine_copies:
        instants = samples.groupBy("drive_id", "moment_us").agg(
            F.count("*").alias("samples"),
            F.sum(active).alias("active"),
            F.max(active).alias("last_active"),
        )
    else:
        instants = samples.select(
            "drive_id",
            "moment_us",
            F.lit(1).cast("bigint").alias("samples"),
            active.alias("active"),
            active.alias("last_active"),
        )
    own = cell_start(F.col("moment_us"), cell_us)
    near_start = F.col("moment_us") - own <= MAX_SAMPLE_GAP_US
    cells = F.when(near_start, F.array(own, own - cell_us)).otherwise(F.array(own))
    in_cell = Window.partitionBy("drive_id", "_cell").orderBy("moment_us", "last_active")
    gap = F.lead("moment_us").over(in_cell) - F.col("moment_us")
    paused = (
        instants.select("*", own.alias("_own"), F.explode(cells).alias("_cell"))
        .select("*", F.when(gap <= MAX_SAMPLE_GAP_US, gap).alias("_gap"))
        .where(F.col("_cell") == F.col("_own"))
    )
    # Samples of one instant follow each other without a pause; the last of
    # them is followed by the pause to the next instant.
    same_instant = F.struct(
        F.lit(0).cast("bigint").alias("gap_us"),
        (F.col("samples") - 1).alias("samples"),
        (F.col("active") - F.col("last_active")).alias("active"),
    )
    last_of_instant = F.struct(
        F.col("_gap").alias("gap_us"),
        F.lit(1).cast("bigint").alias("samples"),
        F.col("last_active").alias("active"),
    )
    both = F.when(F.col("samples") > 1, F.array(same_instant, last_of_instant)).otherwise(
        F.array(last_of_instant)
    )
    return (
        paused.select("drive_id", F.explode(both).alias("_pause"))
        .groupBy("drive_id", F.col("_pause.gap_us").alias("gap_us"))
        .agg(
            F.sum("_pause.samples").alias("samples"),
            F.sum("_pause.active").alias("active"),
        )
    )


def weighted_medians(values: DataFrame, keys: list[str]) -> DataFrame:
    """Exact median per key of `value` (a whole number from 0), each counted `weight` times.

    Returns the keys and `median`, the mean of the two middle values. Counts below the edges of
    fixed cells tell which cell holds the middle, then counts inside that cell tell the value.
    No task needs more than the cells of one key, or the distinct values of one cell, a few
    thousand rows either way. Rows without weight do not count; a key without any is left out.
    """
    cell = F.expr(f"value div {MEDIAN_CELL}").alias("_cell")
    counted = values.where("weight > 0").select(*keys, "value", "weight", cell)
    up_to_here = (Window.unboundedPreceding, Window.currentRow)
    of_key = Window.partitionBy(*keys)
    upto = F.sum("_n").over(of_key.orderBy("_cell").rowsBetween(*up_to_here))
    total = F.sum("_n").over(of_key)
    middle = (
        counted.groupBy(*keys, "_cell")
        .agg(F.sum("weight").alias("_n"))
        .select(
            *keys,
            "_cell",
            (upto - F.col("_n")).alias("_before"),
            upto.alias("_upto"),
            # Ranks from 0 of the two middle values, the same one if the count is odd.
            F.floor((total - 1) / 2).alias("_low"),
            F.floor(total / 2).alias("_high"),
        )
        .where("_before <= _high AND _upto > _low")
    )
    in_cell = Window.partitionBy(*keys, "_cell").orderBy("value").rowsBetween(*up_to_here)
    ranked = counted.join(middle.drop("_upto"), [*keys, "_cell"]).withColumn(
        "_upto", F.col("_before") + F.sum("weight").over(in_cell)
    )
    first = F.col("_upto") - F.col("weight")

    def at(rank: str) -> Column:
        return F.max(F.when((first <= F.col(rank)) & (F.col("_upto") > F.col(rank)), F.col("value")))

    return ranked.groupBy(*keys).agg(((at("_low") + at("_high")) / 2).alias("median"))


def drive_intervals(
    samples: DataFrame,
    cell_us: int = FINE_CELL_US,
    combine_copies: bool = True,
    pauses: DataFrame | None = None,
) -> DataFrame:
    """Per drive: typical interval, active time, and whether one sample makes an event.

    A sample stands for the pause after it if that is above zero and within the
    limit, else for the drive's median of such pauses (0 if there are none).

    `single_sample_counts` tells whether the median of all pauses reaches the
    minimum event duration. For that question pauses beyond the sampling limit
    may count as just beyond it, so exact medians need no unbounded state.

    `pauses` takes a written result of `sample_intervals` to use again; else it is
    computed and written, as sums and medians look at it from several sides.
    """
    if pauses is None:
        pauses = materialize(sample_intervals(samples, cell_us, combine_copies), "pauses")
    gap, count = F.col("gap_us"), F.col("samples")
    usable = (gap > 0) & gap.isNotNull()
    beyond = F.lit(MAX_SAMPLE_GAP_US + 1)
    # The last sample of a drive has a NULL pause that is not a pause at all.
    both = F.array(
        F.struct(
            F.lit("usable").alias("kind"),
            gap.alias("value"),
            F.when(usable, count).otherwise(0).alias("weight"),
        ),
        F.struct(
            F.lit("any").alias("kind"),
            F.coalesce(gap, beyond).alias("value"),
            (count - F.when(gap.isNull(), 1).otherwise(0)).alias("weight"),
        ),
    )
    medians = (
        weighted_medians(
            pauses.select("drive_id", F.inline(both)), ["drive_id", "kind"]
        )
        .groupBy("drive_id")
        .agg(
            F.max(F.when(F.col("kind") == "usable", F.col("median"))).alias("_median_us"),
            F.max(F.when(F.col("kind") == "any", F.col("median"))).alias("_any_median_us"),
        )
    )
    return (
        pauses.groupBy("drive_id")
        .agg(
            F.sum(F.when(usable, gap * F.col("active")).otherwise(0)).alias("_active_us"),
            F.sum(F.when(usable, 0).otherwise(F.col("active"))).alias("_active_other"),
        )
        .join(medians, "drive_id", "left")
        .select(
            "drive_id",
            (F.coalesce("_median_us", F.lit(0.0)) / SECOND_US).alias("typical_interval_s"),
            (
                (
                    F.col("_active_us")
                    + F.col("_active_other") * F.coalesce("_median_us", F.lit(0.0))
                )
                / SECOND_US
            ).alias("active_time_s"),
            F.coalesce(F.col("_any_median_us") >= MIN_EVENT_DURATION_US, F.lit(False)).alias(
                "single_sample_counts"
            ),
        )
    )


def duration_weights(samples: DataFrame, cell_us: int = FINE_CELL_US) -> DataFrame:
    """Seconds each pause length stands for, per drive: `gap_us`, `samples`, `weight_s`.

    The same weights as per sample, one row per distinct pause.
    """
    pauses = materialize(sample_intervals(samples, cell_us), "pauses")
    typical = drive_intervals(samples, cell_us, pauses=pauses)
    gap = F.col("gap_us")
    return pauses.join(typical.select("drive_id", "typical_interval_s"), "drive_id").select(
        "drive_id",
        "gap_us",
        "samples",
        "active",
        F.when(gap > 0, gap / SECOND_US).otherwise(F.col("typical_interval_s")).alias("weight_s"),
    )
