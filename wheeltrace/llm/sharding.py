"""Shards of nearly equal bytes by histogram sort.

Documents are ordered by (hash of the text, doc_id), so copies of a text are neighbours. In each
round every partition counts the exact bytes below candidate keys, the counts are added up, and
the candidates around each wanted boundary are drawn closer, until each boundary is within the
tolerance. Only counts of candidates reach the driver. Then documents are exchanged once, to
slices of a shard small enough for one task, and numbered.

Boundaries lie between texts, so copies stay in one shard, unless a single text's copies weigh
more than a tenth of a shard: then the boundary is refined on their doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wheeltrace.llm.common import known_small
from wheeltrace.operators.scale import materialize

SHARDS = 24
ROW_BYTES = 8
# Of a shard's bytes.
TOLERANCE = 0.002
PROBES = 256
# Copies of a text that weigh less than this share of a shard stay together.
GROUP_SHARE = 0.1
SLICE_BYTES = 64 << 20
# A slice has a row of two numbers; more are joined by shuffle.
BROADCAST_SLICES = 1_000_000

_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def sized_rows(docs: DataFrame) -> DataFrame:
    """All columns of `docs` with `size` and the key (`_hash`, `_id`)."""
    return (
        docs.withColumn(
            "size", (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("bigint")
        )
        .withColumn("_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
        .withColumn("_id", F.coalesce("doc_id", F.lit(_LOW)))
    )


def _below(keys: DataFrame, probes: list[int], key: str) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows whose `key` is below each of the sorted probes."""
    wanted = np.array(probes, np.int64)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((2, len(wanted) + 1), np.int64)
        for batch in batches:
            # Rows below probe n have a place of at most n.
            place = np.searchsorted(wanted, batch[key].to_numpy(), side="right")
            for kind, weights in enumerate((batch["size"].to_numpy(), None)):
                held[kind] += np.bincount(place, weights, held.shape[1]).astype(np.int64)
        used = np.nonzero(held[1])[0]
        yield pd.DataFrame({"place": used, "bytes": held[0, used], "n": held[1, used]})

    counted = (
        keys.select(key, "size")
        .mapInPandas(count, "place bigint, bytes bigint, n bigint")
        .groupBy("place")
        .agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        .collect()
    )
    held = np.zeros((2, len(wanted) + 1), np.int64)
    for row in counted:
        held[:, row["place"]] = row["bytes"], row["n"]
    below = np.cumsum(held, axis=1)[:, :-1]
    return below[0], below[1]


def _refine(
    keys: DataFrame, key: str, targets: dict[int, float], tolerance: float
) -> dict[int, tuple[int, int, int]]:
    """For each target the best boundary as (boundary, bytes below it, bytes of the key there).

    The search ends when a probe is within the tolerance, or when one row or one key is left
    between the probes next to the target. Then the nearer side is the boundary, and the bytes
    of what lies between are told.
    """
    low = dict.fromkeys(targets, (_LOW, 0, 0))
    high: dict[int, tuple[int, int, int]] = {}
    found: dict[int, tuple[int, int, int]] = {}
    while len(found) < len(targets):
        probes: set[int] = set()
        for n in targets:
            if n not in found:
                a, b = low[n][0], high[n][0] if n in high else _HIGH
                probes |= {a + (b - a) * k // PROBES for k in range(1, PROBES)} | {b}
        ordered = sorted(probes)
        size, rows = _below(keys, ordered, key)
        for n, target in targets.items():
            if n in found:
                continue
            near = int(np.argmin(np.abs(size - target)))
            if abs(size[near] - target) <= tolerance:
                found[n] = (ordered[near], int(size[near]), 0)
                continue
            through = int(np.searchsorted(size, target, side="right"))
            if through and ordered[through - 1] > low[n][0]:
                low[n] = (ordered[through - 1], int(size[through - 1]), int(rows[through - 1]))
            if through < len(ordered):
                high[n] = (ordered[through], int(size[through]), int(rows[through]))
            left, right = low[n], high.get(n)
            if right is None:
                # Only rows with the largest key of all are left.
                found[n] = (left[0], left[1], 0)
            elif right[2] - left[2] <= 1 or right[0] - left[0] <= 1:
                between = right[1] - left[1]
                if right[0] - left[0] <= 1 and right[2] - left[2] > 1:
                    found[n] = (left[0], left[1], between)
                else:
                    side = left if target - left[1] <= right[1] - target else right
                    found[n] = (side[0], side[1], 0)
    return found


def splitters(
    keys: DataFrame, parts: int, tolerance: float, group_bytes: float
) -> list[tuple[int, int]]:
    """parts - 1 rising boundaries (_hash, _id) that part the bytes evenly.

    `tolerance` is in bytes. A boundary is the first key of the part after it. Copies of a text
    of at most `group_bytes` together are not parted. Rows equal in text and doc_id cannot be.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    targets = {n: total * n / parts for n in range(1, parts)}
    if not total or not targets:
        return []
    chosen: dict[int, tuple[int, int]] = {}
    heavy: dict[int, dict[int, float]] = {}
    for n, (bound, below, copies) in _refine(keys, "_hash", targets, tolerance).items():
        rest = targets[n] - below
        if copies > group_bytes:
            heavy.setdefault(bound, {})[n] = rest
        else:
            # The next key is the nearer side if most of the copies lie below the target.
            chosen[n] = (bound + (copies > 0 and 2 * rest > copies), _LOW)
    for text_hash, inside in heavy.items():
        copies = keys.where(F.col("_hash") == text_hash)
        for n, (bound, _, _) in _refine(copies, "_id", inside, tolerance).items():
            chosen[n] = (text_hash, bound)
    return sorted(chosen.values())


def _part_of(bounds: list[tuple[int, int]]):
    """The number of boundaries at or below a row's key, as a column."""
    if not bounds:
        return F.lit(0)
    limits = F.lit(np.array([h for h, _ in bounds], np.int64))
    ids = F.lit(np.array([i for _, i in bounds], np.int64))
    pairs = F.arrays_zip(limits.alias("h"), ids.alias("i"))
    key = F.struct(F.col("_hash").alias("h"), F.col("_id").alias("i"))
    return F.size(F.filter(pairs, lambda b: F.struct(b["h"].alias("h"), b["i"].alias("i")) <= key))


def shard(
    docs: DataFrame,
    shards: int = SHARDS,
    tolerance: float = TOLERANCE,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """All columns of `docs` with size, shard and slot; law: nearly equal bytes.

    `size` is the UTF-8 bytes of the text plus 8, of a null text 8. `slot` numbers a shard's
    rows from 0 without gaps. Shards differ from the mean by at most twice the tolerance, or by
    the largest row, or by the copies of a text that are kept together. Null doc_ids come first among equal texts; null and
    empty texts count as equal. Repeated rows get a slot each. An empty table stays empty.
    Columns of these names in the input are replaced.
    """
    docs = docs.drop("shard", "slot", "size")
    rows = sized_rows(docs)
    keys = materialize(rows.select("_hash", "_id", "size"), "keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    share = total / shards
    bounds = splitters(keys, shards, tolerance * share, GROUP_SHARE * share)
    # A shard is numbered in slices, so that no task holds one: rows are dealt to a shard's
    # slices by hash, and each slice starts at the number of rows in those before it.
    slices = max(1, -(-total // (shards * slice_bytes)))
    slice_no = F.pmod(F.xxhash64("_hash", "_id"), F.lit(slices)).cast("int")
    part = (_part_of(bounds) * slices + slice_no).cast("int")
    counts = keys.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    within = Window.partitionBy(F.floor(F.col("_part") / slices)).orderBy("_part")
    starts = counts.select(
        "_part",
        F.coalesce(
            F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_start"),
    )
    number = F.row_number().over(Window.partitionBy("_part").orderBy("_hash", "_id"))
    # One row of two numbers per slice of slice_bytes.
    starts = known_small(materialize(starts, "starts"), BROADCAST_SLICES)
    joined = rows.withColumn("_part", part).withColumn("_number", number).join(starts, "_part")
    return joined.select(
        *docs.columns,
        "size",
        F.floor(F.col("_part") / slices).cast("int").alias("shard"),
        (F.col("_start") + F.col("_number") - 1).cast("bigint").alias("slot"),
    )
