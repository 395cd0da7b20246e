"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of half keys (ten each, two minhashes per half key) are computed per
document. A table key pairs one half key of each collection, so 40 minhashes serve 100 tables
that would otherwise need 400. Documents in one bucket are candidates; links are confirmed on
the full shingle sets.

At similarity 0.75 a half key agrees with probability 0.5625, so two documents meet in some
table with probability (1 - 0.4375^10)^2 = 0.9995, at 0.8 with 0.9999.

How it stays spread out:

* Documents with equal shingle sets are one class and enter once, as their smallest doc_id.
* A half key that only one class has cannot collide, so pairs are only formed from shared
  half keys. That leaves most documents with nothing to shuffle by table.
* The smallest member leads a bucket, and each document is first confirmed against the leader
  it shares most buckets with: one candidate per document. Where confirmed links leave a bucket
  with several components, members of different components are compared by their sketches in
  blocks of bounded size, which nothing caps, and the similar ones are confirmed too. So a
  bucket never lists all its pairs, and no link between components is lost. The blocks follow
  the left half of the table key, the right halves are compared inside, and a pair counts at
  its first common left half only: ten rows per document instead of a hundred.
* Shuffled texts are those of candidate documents, as far as a bitmap of fixed size tells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wheeltrace.llm.common import arrow_slices, map_with_ids, mix, text_slices, word_lists
from wheeltrace.llm.graph import connected_components
from wheeltrace.operators.scale import materialize

SHINGLE_WORDS = 5
HALF_KEYS = 10
HALF_WIDTH = 2
MIN_PERCENT = 75
# The sketch parts the shingle hashes into bins and keeps one byte of each bin's least; it costs
# no further hashing. The least of the bins are a sample of the union without replacement, so
# the deviation of the shared part falls to none for texts with few shingles per bin. Pairs
# more than four deviations short of the similarity are passed over.
SKETCH_BINS = 512
SKETCH_DEVIATIONS = 4.0
BLOCK_ROWS = 1024
# Words of 64 bits in the bitmap of wanted doc_ids, at most as many rows in its broadcast.
BITMAP_WORDS = 1 << 18

_MINHASHES = 2 * HALF_KEYS * HALF_WIDTH
_SKETCH_SCHEMA = (
    "doc_id bigint, n_shingles bigint, set_sum bigint, set_mix bigint, "
    "halves array<bigint>, sketch binary"
)


def shingle_hashes(texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the texts, one text after the other, and their numbers.

    A-Z is lower-cased; a text of fewer than five words has its whole sequence as one shingle.
    """
    words, counts = word_lists(texts, lower=True)
    odd = mix(np.arange(1, SHINGLE_WORDS + 1, dtype=np.uint64)) | np.uint64(1)
    sets, start = [], 0
    for n in counts:
        own, start = words[start : start + n], start + n
        if n == 0:
            sets.append(own)
            continue
        width = min(int(n), SHINGLE_WORDS)
        total = np.full(n - width + 1, width, np.uint64)
        for k in range(width):
            total = mix(total + own[k : len(own) - width + 1 + k] * odd[k])
        sets.append(np.unique(total))
    sizes = np.array([len(s) for s in sets], np.int64)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), sizes


def _bin_sketch(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(texts, bins) bytes, 0 for an empty bin. Shingles are sorted within each text."""
    sketch = np.zeros((len(sizes), SKETCH_BINS), np.uint8)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = owner * SKETCH_BINS + (shingles >> np.uint64(56)).astype(np.int64)
    first = np.append(True, place[1:] != place[:-1]) if len(place) else np.zeros(0, bool)
    values = (mix(shingles[first]) % np.uint64(255)).astype(np.uint8) + np.uint8(1)
    sketch.reshape(-1)[place[first]] = values
    return sketch


def _may_link(left, right, n_left, n_right) -> np.ndarray:
    """Whether sketches (rows of bytes) of sets of these sizes are close enough for a link."""
    share = MIN_PERCENT / 100
    used = ((left | right) != 0).sum(axis=-1)
    same = ((left == right) & (left != 0)).sum(axis=-1)
    # The union's size if the pair just reaches the similarity.
    union = (n_left + n_right) / (1 + share)
    unseen = np.maximum(0, 1 - used / np.maximum(union, 1))
    least = share * used - SKETCH_DEVIATIONS * np.sqrt(share * (1 - share) * used * unseen) - 1
    return (same >= least) & (np.minimum(n_left, n_right) >= share * np.maximum(n_left, n_right))


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    numbers = np.arange(_MINHASHES, dtype=np.uint64)
    flips = mix(numbers + np.uint64(101))
    factors = mix(numbers + np.uint64(901)) | np.uint64(1)
    for batch in batches:
        for part in text_slices(batch["text"]):
            rows = batch.iloc[part]
            shingles, sizes = shingle_hashes(rows["text"].tolist())
            filled = np.nonzero(sizes)[0]
            firsts = (np.cumsum(sizes) - sizes)[filled]
            least = np.zeros((_MINHASHES, len(rows)), np.uint64)
            sums = np.zeros((2, len(rows)), np.uint64)
            if len(filled):
                for k in range(_MINHASHES):
                    values = (shingles ^ flips[k]) * factors[k]
                    least[k, filled] = np.minimum.reduceat(values, firsts)
                sums[0, filled] = np.add.reduceat(shingles, firsts)
                sums[1, filled] = np.add.reduceat(mix(shingles + np.uint64(7)), firsts)
            halves = np.zeros((2 * HALF_KEYS, len(rows)), np.uint64)
            for k in range(HALF_WIDTH):
                halves = mix(halves + least[k::HALF_WIDTH])
            sketch = _bin_sketch(shingles, sizes)
            empty = sizes == 0
            yield pd.DataFrame(
                {
                    "doc_id": rows["doc_id"].to_numpy(),
                    "n_shingles": sizes,
                    "set_sum": sums[0].view(np.int64),
                    "set_mix": sums[1].view(np.int64),
                    "halves": [
                        None if none else own
                        for own, none in zip(halves.T.astype(np.int64), empty, strict=True)
                    ],
                    "sketch": [
                        None if none else own.tobytes()
                        for own, none in zip(sketch, empty, strict=True)
                    ],
                }
            )


def sketch_documents(docs: DataFrame) -> DataFrame:
    """Shingle count, set identity, half keys and sketch of every document, no shuffle."""
    return map_with_ids(docs, ["text"], _sketches, _SKETCH_SCHEMA)


def bucket_members(classes: DataFrame) -> DataFrame:
    """(key, slot, left, node, leader) of every bucket that two or more nodes share.

    `leader` is the smallest node of the bucket; `left`, the left half of its key, is the
    node's half key number `slot`.
    """
    halves = classes.select("node", F.posexplode("halves").alias("slot", "value")).select(
        "node", "slot", F.xxhash64("slot", "value").alias("half")
    )
    shared = (
        halves.groupBy("half")
        .agg(F.min("node").alias("low"), F.max("node").alias("high"))
        .where("low < high")
        .select("half")
    )
    # At most ten half keys per side.
    on_left = F.col("slot") < HALF_KEYS
    sides = (
        halves.join(shared, "half")
        .groupBy("node")
        .agg(
            F.collect_list(F.when(on_left, F.struct("slot", "half"))).alias("lefts"),
            F.collect_list(F.when(~on_left, F.col("half"))).alias("rights"),
        )
    )
    members = sides.select("node", F.explode("lefts").alias("a"), "rights").select(
        "node", "a", F.explode("rights").alias("b")
    )
    members = members.select(
        F.xxhash64("a.half", "b").alias("key"), "a.slot", F.col("a.half").alias("left"), "node"
    ).distinct()
    leaders = (
        members.groupBy("key")
        .agg(F.min("node").alias("leader"), F.max("node").alias("_high"))
        .where("leader < _high")
        .drop("_high")
    )
    return members.join(leaders, "key")


def best_leaders(members: DataFrame) -> DataFrame:
    """(a, b): each node b with the leader a that it shares most buckets with, one at most."""
    shared = (
        members.where("leader < node").groupBy("node", "leader").agg(F.count("*").alias("tables"))
    )
    rank = F.struct(F.col("tables"), -F.col("leader"))
    best = shared.groupBy("node").agg(F.max_by("leader", rank).alias("a"))
    return best.select("a", F.col("node").alias("b"))


def _similar_sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sides = [
            np.frombuffer(b"".join(batch[name]), np.uint8).reshape(-1, SKETCH_BINS)
            for name in ("sketch_a", "sketch_b")
        ]
        sizes = batch["n_a"].to_numpy(), batch["n_b"].to_numpy()
        yield batch.loc[_may_link(*sides, *sizes), ["a", "b"]]


def _filter_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sketches are similar enough for a link of 0.75."""
    both = pairs
    for side in ("a", "b"):
        own = classes.select(
            F.col("node").alias(side),
            F.col("sketch").alias(f"sketch_{side}"),
            F.col("n_shingles").alias(f"n_{side}"),
        )
        both = both.join(own, side)
    return both.mapInPandas(_similar_sketches, "a bigint, b bigint")


def _linked(batches: Iterator) -> Iterator:
    """Pairs whose full shingle sets overlap enough."""
    for batch in batches:
        for part in arrow_slices(batch, ["text_a", "text_b"]):
            rows = part.select(["text_a", "text_b"]).to_pandas()
            numbers, texts = pd.factorize(pd.concat([rows["text_a"], rows["text_b"]]))
            shingles, sizes = shingle_hashes(list(texts))
            sets = np.split(shingles, np.cumsum(sizes)[:-1])
            links = np.zeros(len(rows), bool)
            for k in range(len(rows)):
                left, right = sets[numbers[k]], sets[numbers[len(rows) + k]]
                common = len(np.intersect1d(left, right, assume_unique=True))
                union = len(left) + len(right) - common
                links[k] = common > 0 and 100 * common >= MIN_PERCENT * union
            yield part.select(["a", "b"]).filter(pa.array(links))


def _in_bitmap(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """`docs` without most rows whose doc_id is not in `wanted`; none in it is lost.

    The bitmap is broadcast: it has at most BITMAP_WORDS rows, however many ids it holds. With
    far more ids than its 16.8 million bits it passes every row, and the join after it decides.
    """
    code = F.xxhash64("doc_id")
    word = F.pmod(code, F.lit(BITMAP_WORDS)).cast("int")
    # A function of other bits of the hash than the word number.
    bit = F.shiftrightunsigned(code, 58).cast("int")
    numbered = wanted.select(word.alias("_word"), bit.alias("_shift"))
    bitmap = numbered.groupBy("_word").agg(
        F.expr("bit_or(shiftleft(1L, _shift))").alias("_bits")
    )
    held = docs.withColumn("_word", word).withColumn("_shift", bit)
    return (
        held.join(F.broadcast(bitmap), "_word")
        .where(F.expr("(shiftrightunsigned(_bits, _shift) & 1L) = 1L"))
        .drop("_word", "_shift", "_bits")
    )


def confirm_pairs(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of doc_ids whose documents reach the similarity on their full sets.

    Only the texts of documents that occur in a pair are kept after the first join, and few
    others reach it.
    """
    pairs = materialize(pairs, "pairs")
    # Each side is reduced to its ids first; the bitmap and the join both read the result.
    lower, upper = (pairs.select(F.col(side).alias("doc_id")).distinct() for side in ("a", "b"))
    wanted = materialize(lower.union(upper).distinct(), "wanted")
    texts = _in_bitmap(docs.select("doc_id", "text"), wanted)
    texts = texts.join(wanted, "doc_id", "left_semi")
    texts = materialize(texts.distinct(), "texts")
    both = pairs.join(
        texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a"
    ).join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    # A doc_id without a text in one of its rows has no shingles there.
    both = both.where("text_a IS NOT NULL AND text_b IS NOT NULL")
    return materialize(both.mapInArrow(_linked, "a bigint, b bigint").distinct(), "links")


def _across_components(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Similar pairs of different components within each (left, low, high) block.

    A pair must share a right half too, and counts where its first common left half is.

    Rows arrive sorted by block; a block that ends in a later batch is carried over.
    """
    held = None
    names = ["left", "low", "high"]

    def blocks(frame):
        keys = frame[names].to_numpy()
        cuts = np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1
        sketches = np.frombuffer(b"".join(frame["sketch"]), np.uint8).reshape(-1, SKETCH_BINS)
        nodes, labels = frame["node"].to_numpy(), frame["component_id"].to_numpy()
        own, sizes = frame["block"].to_numpy(), frame["n_shingles"].to_numpy()
        halves, slots = np.stack(frame["halves"].to_numpy()), frame["slot"].to_numpy()
        lefts_of, rights_of = halves[:, :HALF_KEYS], halves[:, HALF_KEYS:]
        edges = np.r_[0, cuts, len(frame)]
        found = []
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            cell = slice(start, end)
            if (labels[cell] == labels[start]).all():
                continue
            low, high = keys[start, 1], keys[start, 2]
            lefts = np.nonzero(own[cell] == low)[0] + start
            rights = np.nonzero(own[cell] == high)[0] + start
            for left in lefts:
                # Inside one block each pair is looked at once, between two blocks always.
                others = rights[nodes[rights] > nodes[left]] if low == high else rights
                others = others[labels[others] != labels[left]]
                if len(others):
                    earlier = slice(0, slots[left])
                    table = (rights_of[others] == rights_of[left]).any(axis=1)
                    table &= ~(lefts_of[others, earlier] == lefts_of[left, earlier]).any(axis=1)
                    others = others[table]
                if len(others):
                    others = others[
                        _may_link(sketches[others], sketches[left], sizes[others], sizes[left])
                    ]
                    mine = np.full(len(others), nodes[left])
                    found.append(
                        np.stack([np.minimum(mine, nodes[others]), np.maximum(mine, nodes[others])])
                    )
        pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0))
        return pd.DataFrame({"a": pairs[0].astype(np.int64), "b": pairs[1].astype(np.int64)})

    for batch in batches:
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        last = (batch[names] == batch[names].iloc[-1]).all(axis=1).to_numpy()
        held = batch[last]
        if not last.all():
            yield blocks(batch[~last])
    if held is not None and len(held):
        yield blocks(held)


def pairs_across(members: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """Similar pairs that share a bucket and are not yet in one component.

    Members of one left half are n rows, cut into ceil(n / 1024) blocks, and every pair of
    blocks is one group of at most about 2,048 rows, so no task holds a bucket.
    """
    labelled = members.join(labels, "node", "left").select(
        "key", "slot", "left", "node", F.coalesce("component_id", "node").alias("component_id")
    )
    labelled = materialize(labelled, "labelled")
    mixed = (
        labelled.groupBy("key")
        .agg(F.min("component_id").alias("low"), F.max("component_id").alias("high"))
        .where("low < high")
        .select("key")
    )
    open_rows = materialize(
        labelled.join(mixed, "key").select("slot", "left", "node", "component_id").distinct(),
        "open",
    )
    sizes = open_rows.groupBy("left").agg(
        F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")
    )
    rows = open_rows.join(sizes, "left").withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    )
    rows = rows.join(classes.select("node", "halves", "sketch", "n_shingles"), "node")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        "left",
        F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
        "block",
        "slot",
        "node",
        "component_id",
        "halves",
        "sketch",
        "n_shingles",
    )
    return (
        rows.repartition("left", "low", "high")
        .sortWithinPartitions("left", "low", "high")
        .mapInPandas(_across_components, "a bigint, b bigint")
        .distinct()
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of `docs` (doc_id, text).

    Documents are linked if their sets of distinct five-word shingles have a Jaccard
    similarity of 0.75 or more; component_id is the smallest doc_id that links reach.

    * Null or empty texts, or texts without words: no shingles, linked with nothing, kept.
    * Rows that share a doc_id are one document in linking: with equal texts they get equal
      rows, with different texts they join the groups of both.
    * A null doc_id cannot be named by others: component_id is null and the row is kept.
    * An empty table gives an empty result; other columns are ignored.
    """
    sketched = materialize(sketch_documents(docs), "sketched")
    classes = (
        sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("set_sum", "set_mix", "n_shingles")
        .agg(
            F.min("doc_id").alias("node"),
            F.any_value("halves").alias("halves"),
            F.any_value("sketch").alias("sketch"),
        )
    )
    classes = materialize(classes, "classes")
    members = materialize(bucket_members(classes), "members")
    links = confirm_pairs(_filter_pairs(best_leaders(members), classes), docs)
    labels = connected_components(links)
    left = pairs_across(members, classes, labels)
    more = confirm_pairs(left.join(links, ["a", "b"], "left_anti"), docs)
    labels = connected_components(
        links.union(more).union(_shared_ids(sketched, classes)).distinct()
    )
    identity = ["set_sum", "set_mix", "n_shingles"]
    named = classes.join(labels, "node", "left").select(
        *identity, F.coalesce("component_id", "node").alias("component_id")
    )
    joined = sketched.select("doc_id", *identity).join(named, identity, "left")
    component = F.when(
        F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")
    )
    return joined.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def _shared_ids(sketched: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of a doc_id that occurs with several texts."""
    identity = ["set_sum", "set_mix", "n_shingles"]
    rows = sketched.where("n_shingles > 0").select("doc_id", *identity)
    repeated = (
        rows.groupBy("doc_id")
        .agg(F.min(F.struct(*identity)).alias("low"), F.max(F.struct(*identity)).alias("high"))
        .where("low != high")
        .select("doc_id")
    )
    return (
        rows.join(repeated, "doc_id")
        .join(classes.select(*identity, "node"), identity)
        .where("node != doc_id")
        .select(F.least("node", "doc_id").alias("a"), F.greatest("node", "doc_id").alias("b"))
    )
