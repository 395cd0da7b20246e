"""Building blocks that keep work spread out when one key holds much of the data."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SALT = "_salt"
_SLICE = "_slice"
_BEFORE = "_before"

# Copies of a lookup row; a key's rows are spread over as many join tasks.
SALTS = 32


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The cluster names it in `spark.checkpoint.dir`. Only a local session, which
    has no executors on other machines, may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder all executors share.")
    folder = tempfile.mkdtemp(prefix="wheeltrace-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


# The JVM interprets longer methods instead of compiling them.
COMPILED_METHOD_BYTES = 8000


def compiled_stages(spark: SparkSession) -> None:
    """Have Spark generate only code that the JVM compiles, in this session.

    A stage of many columns makes one method; beyond this length each row is interpreted, at
    several times the cost. Spark then generates code by operator, in short methods.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(name)) > COMPILED_METHOD_BYTES:
        spark.conf.set(name, str(COMPILED_METHOD_BYTES))


# Spark removes the shuffle files of a query when it ends.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(frame: DataFrame, label: str, free_shuffles: bool = False) -> DataFrame:
    """Write the frame to the shared folder and read it back.

    Downstream branches then scan Parquet instead of repeating the work, and a
    lost executor costs a re-read. Row positions become fixed by the write.

    The write's shuffle files lie on disk until the driver happens to collect its garbage;
    with `free_shuffles` they go when the write ends.
    """
    spark = frame.sparkSession
    path = f"{checkpoint_folder(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_FREE_SHUFFLES)
    spark.conf.set(_FREE_SHUFFLES, str(free_shuffles or before == "true").lower())
    try:
        frame.write.parquet(path)
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)
    return spark.read.schema(frame.schema).parquet(path)


def known_small(frame: DataFrame, rows: int) -> DataFrame:
    """Mark a written frame for broadcast if it has at most `rows` rows, else leave it."""
    few = len(frame.select(F.lit(1)).take(rows + 1)) <= rows
    return F.broadcast(frame) if few else frame


def stored_order(frame: DataFrame) -> DataFrame:
    """A frame read from files, its rows in the order in which Spark wrote them.

    A scan groups files by size. Rows are range-partitioned on the number of the part, the
    file's name and the row in it, so partitions and their rows follow the written order.
    """
    keys = ["_part", "_file", "_row"]
    number = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1)
    placed = frame.select(
        "*",
        # The name alone would put part 100000 before part 99999.
        number.try_cast("bigint").alias("_part"),
        F.col("_metadata.file_name").alias("_file"),
        F.col("_metadata.row_index").alias("_row"),
    )
    return placed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys)


def by_shuffle(frame: DataFrame) -> DataFrame:
    """Mark a side of a join that grows with the data: it must not be broadcast.

    Spark takes the size of a written table's files for that of its rows, and copies by
    `explode` for nothing. A few megabytes of Parquet may be gigabytes in the driver.
    """
    return frame.hint("merge")


def salted_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: list[str],
    spread_by: list[str],
    how: str = "left",
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join where many facts may share one key and lookup keys are unique.

    Facts of a key are split by a hash of `spread_by`; each lookup row is copied
    once per salt.
    """
    spread = facts.withColumn(_SALT, F.pmod(F.xxhash64(*spread_by), F.lit(salts)))
    numbers = F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))
    copies = lookup.withColumn(_SALT, F.explode(numbers))
    return spread.join(by_shuffle(copies), [*on, _SALT], how).drop(_SALT)


def running_total(
    frame: DataFrame,
    groups: list[str],
    order: list[str],
    amount: Column,
    name: str,
) -> DataFrame:
    """Add `name`: the sum of `amount` up to and including the row, per group.

    A window per group would put a whole group into one task. Instead rows are
    range-partitioned on (groups, order), which splits any group evenly; each
    slice is summed on its own and starts from the total of the slices before
    it. (groups, order) must be unique, and the number of groups small.
    """
    sliced = materialize(
        frame.repartitionByRange(*groups, *order).withColumn(_SLICE, F.spark_partition_id()),
        "slices",
    )
    totals = sliced.groupBy(*groups, _SLICE).agg(F.sum(amount).alias("_sum"))
    earlier = Window.partitionBy(*groups).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *groups, _SLICE, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias(_BEFORE)
    )
    within = (
        Window.partitionBy(*groups, _SLICE)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # Slices are contiguous, so offsets has at most (slices + groups - 1) rows:
    # a few thousand whatever the size of the frame. Safe to broadcast.
    return (
        sliced.join(F.broadcast(offsets), [*groups, _SLICE])
        .withColumn(name, F.sum(amount).over(within) + F.col(_BEFORE))
        .drop(_SLICE, _BEFORE)
    )


# A group with more than 1 / HEAVY_SHARE of all rows is joined by broadcast; there are fewer
# than HEAVY_SHARE of them, whatever the data.
HEAVY_SHARE = 4096


def grouped_join(
    rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int
) -> DataFrame:
    """Inner join of rows with the row of their group, where a few groups may hold most rows.

    `groups` has one row per group, with its number of rows in `size` (dropped from the
    result); `total` is the number of all rows; keys are not null. Heavy groups are broadcast
    (fewer than HEAVY_SHARE rows), the others join by shuffle, where no key has more than
    1 / HEAVY_SHARE of the rows. `rows` is read twice: hand over a written table.
    """
    is_heavy = F.col(size) * F.lit(HEAVY_SHARE) > F.lit(total)
    heavy = groups.where(is_heavy).drop(size)
    light = groups.where(~is_heavy).drop(size)
    others = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(light, on)
    return rows.join(F.broadcast(heavy), on).unionByName(others)


def running_in_groups(
    frame: DataFrame, groups: list[str], order: list[str], totals: dict[str, Column]
) -> DataFrame:
    """Add running aggregates per group, up to and including the row, of groups of any size.

    `totals` maps new names to aggregates that can be merged by adding (F.sum, F.count) or,
    where the name begins with `xor`, by bit_xor. Rows are range-partitioned on
    (groups, order), which splits a large group; (groups, order) should be unique and the
    group columns not null. Only groups at the edge of a slice need the totals of earlier
    slices: at most two per slice, so that table has a few rows per slice and is broadcast.
    """
    sliced = materialize(
        frame.repartitionByRange(*groups, *order).withColumn(_SLICE, F.spark_partition_id()),
        "slices",
    )
    ends = sliced.groupBy(_SLICE).agg(
        F.min(F.struct(*groups)).alias("low"), F.max(F.struct(*groups)).alias("high")
    )
    edges = ends.select(F.explode(F.array("low", "high")).alias("edge")).select("edge.*")
    pieces = (
        sliced.join(F.broadcast(edges.distinct()), groups)
        .groupBy(*groups, _SLICE)
        .agg(*[total.alias(_BEFORE + name) for name, total in totals.items()])
    )
    earlier = Window.partitionBy(*groups).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    merged = {
        name: (F.bit_xor if name.startswith("xor") else F.sum)(_BEFORE + name) for name in totals
    }
    offsets = pieces.select(
        *groups, _SLICE, *[m.over(earlier).alias(_BEFORE + name) for name, m in merged.items()]
    )
    within = (
        Window.partitionBy(*groups, _SLICE)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    result = sliced.join(F.broadcast(offsets), [*groups, _SLICE], "left")
    for name, total in totals.items():
        before = F.coalesce(_BEFORE + name, F.lit(0))
        own = total.over(within)
        joined = own.bitwiseXOR(before) if name.startswith("xor") else own + before
        result = result.withColumn(name, joined)
    return result.drop(_SLICE, *[_BEFORE + name for name in totals])
