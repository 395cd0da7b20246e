"""Mix sources to target weights by Pfair scheduling, with DataFrame operations only.

Each source's documents, in a pseudo-random order, form blocks of about equal bytes. At virtual
time v a source of weight w and b blocks is due min(w * v, b) blocks, and the slot in which v is
reached is the sum of that over all sources, so one that runs out leaves its share to the others
in proportion to their weights. Block i may start at the slot, rounded down, at which its source
is due i blocks, and must be done by the slot, rounded up, at which it is due i + 1. While no
source has run out these are floor(i / w) and ceil((i + 1) / w) for weights that sum to 1.
Earliest deadline first then keeps every source within one block of its target at every slot of
the whole schedule.

Weights are integers, as large as 64 bits allow for the number of blocks, so all windows are
exact. Which block comes next depends on all blocks before it, so the schedule is one fold, over
sources and blocks but not documents; all else are plain joins.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wheeltrace.llm.common import known_small
from wheeltrace.operators.scale import materialize, running_total

BLOCK_BYTES = 1 << 18
# Slots that the fold appends at a time.
FOLD_SLOTS = 256
# Default targets are in proportion to a source's bytes to this power.
EXPONENT = 0.5
# A row of the plan has about 60 bytes; longer plans are joined by shuffle.
BROADCAST_PLAN = 200_000
# Weights times blocks stay below this, so that their sums fit in 64 bits.
LARGEST_PRODUCT = float(1 << 61)


def source_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, source, size, block, at: a document belongs to the block its first byte is in.

    A document longer than a block leaves the blocks it covers empty, so its source is charged
    for all its bytes. The running total splits a source of any size evenly over tasks.
    """
    sized = materialize(
        docs.select(
            "doc_id",
            "source",
            # A byte more than the text, so that empty and null texts have a place as well.
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
            F.xxhash64("doc_id").alias("shuffled"),
            F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_hash"),
        ),
        "sized",
    )
    # Rows equal in every column are told apart by their number in a small group.
    counted = sized.groupBy("source", "shuffled", "doc_id", "text_hash", "size").agg(
        F.count("*").alias("copies")
    )
    placed = running_total(
        counted.withColumn("_null", F.col("source").isNull()).withColumn(
            "_source", F.coalesce("source", F.lit(""))
        ),
        ["_null", "_source"],
        ["shuffled", "doc_id", "text_hash"],
        F.col("size") * F.col("copies"),
        "through",
    )
    start = F.col("through") - F.col("size") * F.col("copies")
    rows = placed.withColumn(
        "copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1))
    )
    return rows.select(
        "doc_id",
        "source",
        "text_hash",
        "size",
        F.floor((start + F.col("copy") * F.col("size")) / block_bytes).alias("block"),
        (start + F.col("copy") * F.col("size")).alias("at"),
    )


def target_weights(
    totals: DataFrame, weights: Mapping[str, float] | None, round_slots: int | None = None
) -> DataFrame:
    """`totals` (source, blocks) with `weight`: an integer in proportion to the target.

    Without given weights the target is the number of blocks to the power EXPONENT. Sources
    that `weights` does not name, and the null source, get its smallest weight. Rounding moves
    the end of a schedule of n blocks by less than n * n / 2^61 blocks. Only with `round_slots`
    are targets rounded to whole blocks, one at least, of a round of so many slots.
    """
    if weights:
        least = min(weights.values())
        pairs = [F.lit(x) for item in weights.items() for x in item]
        weight = F.coalesce(F.element_at(F.create_map(*pairs), F.col("source")), F.lit(least))
    else:
        weight = F.pow("blocks", F.lit(EXPONENT))
    weighed = totals.withColumn("weight", weight.cast("double"))
    parts = F.lit(float(round_slots)) if round_slots else F.lit(LARGEST_PRODUCT) / F.sum("blocks")
    unit = weighed.agg((parts / F.sum("weight")).alias("unit")).scalar()
    whole = F.greatest(F.lit(1), F.round(F.col("weight") * unit).cast("bigint"))
    return weighed.select("source", "blocks", whole.alias("weight"))


def slot_plan(targets: DataFrame) -> DataFrame:
    """One row per block of the whole schedule: source, block, release, due, slot."""
    gathered = targets.agg(
        F.sort_array(F.collect_list(F.struct("source", "blocks", "weight"))).alias("sources"),
        F.sum("blocks").alias("slots"),
    ).where("slots > 0")

    def window(n: str, block: str) -> str:
        """Of a source's block; after the last one a window that never opens."""
        own = f"sources[{n}].weight"
        reached = (
            "aggregate(sources, cast(0 AS bigint), (sum, s) -> "
            f"sum + least(s.weight * ({{}}), s.blocks * {own}))"
        )
        return f"""if({block} < sources[{n}].blocks, named_struct(
            'due', ({reached.format(f"{block} + 1")} + {own} - 1) div {own},
            'n', {n},
            'release', {reached.format(block)} div {own},
            'block', {block}), {never.format(n=n, block=block)})"""

    # Of the released blocks the one with the earliest deadline goes next. A source's entry in
    # `next` is its first block that has no slot yet.
    entry = "struct<due: bigint, n: int, release: bigint, block: bigint>"
    latest = (1 << 63) - 1
    never = f"named_struct('due', {latest}L, 'n', {{n}}, 'release', {latest}L, 'block', {{block}})"
    inner = f"struct<next: array<{entry}>, chosen: array<{entry}>>"
    outer = f"struct<next: array<{entry}>, rounds: array<array<{entry}>>>"
    step = f"""aggregate(
      sequence(first, least(first + {FOLD_SLOTS}, slots) - 1),
      cast(named_struct('next', held.next, 'chosen', array()) AS {inner}),
      (acc, t) -> transform(
        array(array_min(filter(acc.next, c -> c.release <= t))),
        best -> cast(named_struct(
          'next', transform(acc.next, c -> if(c.n = best.n, {window("c.n", "(c.block + 1)")}, c)),
          'chosen', concat(acc.chosen, array(best))) AS {inner}))[0])"""
    rounds = gathered.select(
        F.expr(
            f"""aggregate(
              sequence(cast(0 AS bigint), slots - 1, {FOLD_SLOTS}L),
              cast(named_struct(
                'next', transform(sources, (x, n) -> {window("n", "cast(0 AS bigint)")}),
                'rounds', array()) AS {outer}),
              (held, first) -> transform(
                array({step}),
                done -> cast(named_struct(
                  'next', done.next,
                  'rounds', concat(held.rounds, array(done.chosen))) AS {outer}))[0],
              held -> held.rounds)"""
        ).alias("rounds"),
        "sources",
    )
    each = rounds.select("sources", F.posexplode("rounds").alias("round", "chosen")).select(
        "sources", "round", F.posexplode("chosen").alias("place", "entry")
    )
    return each.select(
        F.expr("sources[entry.n].source").alias("source"),
        "entry.block",
        "entry.release",
        "entry.due",
        (F.col("round").cast("bigint") * FOLD_SLOTS + F.col("place")).alias("slot"),
    )


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    block_bytes: int = BLOCK_BYTES,
    round_slots: int | None = None,
) -> DataFrame:
    """Every row of `docs` (doc_id, text, source) with its block and slot in the mixture.

    Returns doc_id, source, text_hash, size, block, at, release, due, slot. Reading slots in
    order, and a slot's documents by `at`, gives the mixture; a source that runs out leaves its
    share to the others. All rows are kept: repeated rows take one place each, null and empty
    texts one byte. The null source counts as a source, as the smallest name. An empty table
    gives an empty result.
    """
    placed = materialize(source_blocks(docs, block_bytes), "blocks")
    totals = materialize(
        placed.groupBy("source").agg((F.max("block") + 1).alias("blocks")), "totals"
    )
    targets = materialize(target_weights(totals, weights, round_slots), "targets")
    plan = materialize(slot_plan(targets), "plan")
    # A block has at most `block_bytes` documents, so no key of the join is large.
    plan = known_small(plan.withColumn("_name", F.struct("source")).drop("source"), BROADCAST_PLAN)
    return (
        placed.withColumn("_name", F.struct("source"))
        .join(plan, ["_name", "block"])
        .select(
            "doc_id", "source", "text_hash", "size", "block", "at", "release", "due", "slot"
        )
    )


def mixed_order(docs: DataFrame, partition_bytes: int = 32 << 20, **targets) -> DataFrame:
    """The rows of `docs`, stored in the order of the mixture: files and their rows follow it.

    Rows equal in doc_id, source and text stand together, at the first of their places.
    """
    places = (
        mix(docs, **targets)
        .groupBy("doc_id", "source", "text_hash")
        .agg(F.min(F.struct("slot", "at")).alias("_place"), F.sum("size").alias("size"))
    )
    places = materialize(places, "places")
    totals = places.agg(F.max("_place.slot"), F.sum("size")).first()
    slots, parts = (totals[0] or 0) + 1, (totals[1] or 0) // partition_bytes + 1
    here = docs.withColumn("_text_hash", F.coalesce(F.xxhash64("text"), F.lit(0)))
    there = places.select(
        F.col("doc_id").alias("_doc_id"),
        F.col("source").alias("_source"),
        F.col("text_hash").alias("_hash"),
        "_place",
    )
    rows = here.join(
        there,
        F.col("doc_id").eqNullSafe(F.col("_doc_id"))
        & F.col("source").eqNullSafe(F.col("_source"))
        & (F.col("_text_hash") == F.col("_hash")),
    )
    return (
        rows.repartitionById(parts, F.floor(F.col("_place.slot") * parts / slots).cast("int"))
        .sortWithinPartitions("_place")
        .select(*docs.columns)
    )
