"""Prefix trie of conversations by fixed-length block hashing.

Conversations are grouped by chained digests of blocks of BLOCK turns first. Where all members
that enter a block agree on the whole of it, its inner turns have the same members, so one
representative's turns stand for them. Only in blocks where siblings diverge (or somebody ends)
are the members compared turn by turn.

A node is named by its depth and 128 bits: the exclusive or of one hash per turn, taken of the
turn's position and the SHA-256 of its role and text. Such a digest can be chained across the
tasks that hold parts of one long conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wheeltrace.operators.scale import grouped_join, materialize, running_in_groups

BLOCK = 4
# A rebuilt conversation takes at most this many turns from its group's first conversation.
MAX_HEAD = 8
GROUP = 5
# Ids joined to one piece of text before a node's ids are hashed in order.
PIECE_IDS = 4096

_NODE = ["depth", "x1", "x2"]
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def _head_length(conv: Column) -> Column:
    return F.pmod(F.crc32(conv.cast("string")), F.lit(MAX_HEAD + 1))


def _turn_hash(position: Column, content: Column, which: int) -> Column:
    return F.xxhash64(F.lit(which), position.cast("bigint"), content)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, content, n_bytes), pos from 0 in order of turn, null first.

    Turns of equal number are ordered by role, then by the hash of the text; rows alike in
    all of these are one turn each. Rows without conv_id belong to no conversation.
    """
    role, text = (F.coalesce(name, F.lit("")) for name in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        "conv_id",
        "turn",
        role.alias("role"),
        # The length keeps role and text apart.
        F.unhex(
            F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
        ).alias("content"),
        F.octet_length(text).cast("bigint").alias("n_bytes"),
    )
    placed = running_in_groups(
        turns, ["conv_id"], ["turn", "role", "content"], {"number": F.count(F.lit(1))}
    )
    return placed.select("conv_id", (F.col("number") - 1).alias("pos"), "content", "n_bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, length) and their turns (conv_id, length, i, content, n_bytes).

    A conversation begins with the first turns of its group's first one, as many as its own
    id tells (all, if there are fewer; none, if it is absent), then has its own later turns.
    """
    own = turns.groupBy("conv_id").agg(F.count("*").alias("own_turns"))
    named = own.select(
        "*",
        (F.col("conv_id") - F.col("conv_id") % GROUP).alias("first_id"),
        _head_length(F.col("conv_id")).alias("head"),
    )
    firsts = own.select(F.col("conv_id").alias("first_id"), F.col("own_turns").alias("_turns"))
    taken = F.least("head", F.coalesce("_turns", F.lit(0)))
    convs = materialize(
        named.join(firsts, "first_id", "left").select(
            "conv_id",
            "first_id",
            "own_turns",
            "head",
            taken.alias("taken"),
            (taken + F.greatest(F.col("own_turns") - F.col("head"), F.lit(0))).alias("length"),
        ),
        "conversations",
    )
    # At most GROUP conversations share a first one, and each takes at most MAX_HEAD turns.
    borrowed = (
        turns.where(F.col("pos") < MAX_HEAD)
        .withColumnRenamed("conv_id", "first_id")
        .join(convs.where("taken > 0"), "first_id")
        .where("pos < head")
        .select("conv_id", "length", F.col("pos").alias("i"), "content", "n_bytes")
    )
    kept = grouped_join(
        turns,
        convs.select("conv_id", "head", "taken", "length", "own_turns"),
        ["conv_id"],
        "own_turns",
        turns.count(),
    ).where("pos >= head")
    place = F.col("pos") - F.col("head") + F.col("taken")
    moved = kept.select("conv_id", "length", place.alias("i"), "content", "n_bytes")
    return convs.select("conv_id", "length"), borrowed.unionByName(moved)


def chained_blocks(turns: DataFrame) -> DataFrame:
    """One row per conversation and block of BLOCK turns, with its chained digest.

    (conv_id, length, block, n, turns: at most BLOCK structs by position, b1, b2: own
    digest, xor1, xor2: digest up to the block's end, p1, p2: digest before it).
    """
    hashed = turns.select(
        "conv_id",
        "length",
        F.expr(f"i div {BLOCK}").alias("block"),
        "i",
        _turn_hash(F.col("i"), F.col("content"), 1).alias("h1"),
        _turn_hash(F.col("i"), F.col("content"), 2).alias("h2"),
        "n_bytes",
    )
    blocks = hashed.groupBy("conv_id", "block").agg(
        F.max("length").alias("length"),
        F.count("*").alias("n"),
        F.sort_array(F.collect_list(F.struct("i", "h1", "h2", "n_bytes"))).alias("turns"),
        F.bit_xor("h1").alias("b1"),
        F.bit_xor("h2").alias("b2"),
    )
    chained = running_in_groups(
        blocks, ["conv_id"], ["block"], {"xor1": F.bit_xor("b1"), "xor2": F.bit_xor("b2")}
    )
    return chained.select(
        "*",
        F.col("xor1").bitwiseXOR(F.col("b1")).alias("p1"),
        F.col("xor2").bitwiseXOR(F.col("b2")).alias("p2"),
    )


def _at_turn(met: DataFrame) -> DataFrame:
    """One row per turn of each block: depth, digest up to the turn and before it, bytes."""
    turns = met.select("*", F.explode(F.sequence(F.lit(0), F.size("turns") - 1)).alias("at"))
    upto = F.slice("turns", F.lit(1), F.col("at") + 1)
    digests = [
        F.aggregate(upto, F.col("p1"), lambda x, t: x.bitwiseXOR(t["h1"])).alias("x1"),
        F.aggregate(upto, F.col("p2"), lambda x, t: x.bitwiseXOR(t["h2"])).alias("x2"),
    ]
    turn = F.get("turns", F.col("at"))
    return turns.select(
        *met.columns,
        (F.col("block") * BLOCK + F.col("at") + 1).alias("depth"),
        *digests,
        turn["h1"].alias("_h1"),
        turn["h2"].alias("_h2"),
        turn["n_bytes"].alias("n_bytes"),
    ).select(
        "*",
        F.col("x1").bitwiseXOR(F.col("_h1")).alias("q1"),
        F.col("x2").bitwiseXOR(F.col("_h2")).alias("q2"),
    )


def members_and_inner_nodes(blocks: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Who belongs to which nodes, and the inner nodes of agreed blocks.

    Members (conv_id, length, depth, x1, x2, q1, q2: the parent's digest, n_bytes) have one row
    per conversation and node in blocks where members differ, and one per conversation and
    block, at the block's last turn, where all who enter it agree. Inner nodes are read off the
    smallest member of an agreed block, with the key (e1, e2) of the block's last node.
    """
    whole = F.struct("b1", "b2", "n")
    key = ["block", "p1", "p2"]
    parents = materialize(
        blocks.groupBy(*key).agg(
            F.count("*").alias("n_convs"),
            F.count("*").alias("_size"),
            F.min("conv_id").alias("least"),
            ((F.min(whole) == F.max(whole)) & (F.min("n") == BLOCK)).alias("agreed"),
        ),
        "block-parents",
    )
    met = grouped_join(blocks, parents, key, "_size", blocks.count())
    refined = _at_turn(met.where("NOT agreed"))
    last = F.get("turns", F.lit(BLOCK - 1))
    agreed = met.where("agreed").select(
        "conv_id",
        "length",
        (F.col("block") * BLOCK + BLOCK).alias("depth"),
        F.col("xor1").alias("x1"),
        F.col("xor2").alias("x2"),
        F.col("xor1").bitwiseXOR(last["h1"]).alias("q1"),
        F.col("xor2").bitwiseXOR(last["h2"]).alias("q2"),
        last["n_bytes"].alias("n_bytes"),
    )
    zero = F.lit(0).cast("bigint")
    root = convs.select(
        "conv_id", "length", *[zero.alias(n) for n in ("depth", "x1", "x2", "q1", "q2", "n_bytes")]
    )
    members = root.unionByName(agreed).unionByName(refined.select(*agreed.columns))
    inner = (
        _at_turn(met.where("agreed AND conv_id = least"))
        .where(F.col("depth") % BLOCK != 0)
        .select(
            *_NODE,
            "q1",
            "q2",
            "n_bytes",
            "conv_id",
            "n_convs",
            F.lit(False).alias("leaf"),
            (F.col("block") * BLOCK + BLOCK).alias("e_depth"),
            F.col("xor1").alias("e1"),
            F.col("xor2").alias("e2"),
        )
    )
    return members, inner


def ids_hashed(ends: DataFrame) -> DataFrame:
    """(depth, x1, x2, ends_sha256) of the conversations that end at a node, in order of id.

    Ids are joined to pieces of at most PIECE_IDS in parallel. One task then feeds a node's
    pieces to the hash one after another, as SHA-256 needs, and holds one at a time.
    """
    placed = ends.repartitionByRange(*_NODE, "conv_id").withColumn(
        "_slice", F.spark_partition_id()
    )
    order = Window.partitionBy("_slice", *_NODE).orderBy("conv_id")
    pieces = materialize(placed, "ends").withColumn(
        "_piece", F.floor((F.row_number().over(order) - 1) / PIECE_IDS)
    )
    joined = pieces.groupBy(*_NODE, "_slice", "_piece").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ","
        ).alias("ids")
    )

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state, done = None, None, []
        for batch in batches:
            columns = (batch[name] for name in (*_NODE, "ids"))
            for depth, x1, x2, ids in zip(*columns, strict=True):
                if node != (depth, x1, x2):
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = (depth, x1, x2), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if done:
                yield pd.DataFrame(done, columns=[*_NODE, "ends_sha256"])
                done = []
        if node is not None:
            yield pd.DataFrame([(*node, state.hexdigest())], columns=[*_NODE, "ends_sha256"])

    return (
        joined.repartition(*_NODE)
        .sortWithinPartitions(*_NODE, "_slice", "_piece")
        .select(*_NODE, "ids")
        .mapInPandas(hashed, "depth bigint, x1 bigint, x2 bigint, ends_sha256 string")
    )


def _member_sums(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per span of nodes: what its members' own nodes add up to (leaves and saved bytes).

    A node counts for its smallest member only, its own conversation.
    """
    own = nodes.groupBy("conv_id").agg(
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
    )
    sizes = members.groupBy("conv_id").agg(F.count("*").alias("_size"))
    weights = sizes.join(own, "conv_id", "left").na.fill(0, ["leaves", "saved"])
    held = members.select("conv_id", *_NODE)
    weighed = grouped_join(
        held, materialize(weights, "weights"), ["conv_id"], "_size", members.count()
    )
    return weighed.groupBy(*_NODE).agg(
        F.sum("leaves").alias("all_leaves"), F.sum("saved").alias("all_saved")
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, the root included.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. Null role or text is empty, a null turn comes first; rows
    without conv_id belong to no conversation; repeated rows are turns of their own. An empty
    table has no conversation and gives no row. Other columns are not read.

    A subtree's nodes are those whose smallest member is a member of its top, but for that
    conversation's own nodes above the top. So a subtree's sum is a sum over members less a
    running total along one conversation, and no node visits its ancestors.
    """
    turns = materialize(numbered_turns(conversations), "turns")
    convs, moved = rebuilt(turns)
    blocks = materialize(chained_blocks(moved), "blocks")
    members, inner = members_and_inner_nodes(blocks, convs)
    members = materialize(members, "members")
    ends_here = F.col("length") == F.col("depth")
    ends = members.groupBy(*_NODE).agg(
        F.max("q1").alias("q1"),
        F.max("q2").alias("q2"),
        F.max("n_bytes").alias("n_bytes"),
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.min(ends_here).alias("leaf"),
    )
    named = ends.select(
        "*",
        F.col("depth").alias("e_depth"),
        F.col("x1").alias("e1"),
        F.col("x2").alias("e2"),
    ).unionByName(inner)
    nodes = materialize(
        named.select(
            *[name for name in named.columns if name not in ("leaf", "n_bytes")],
            F.col("leaf").cast("bigint").alias("leaves"),
            ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"),
        ),
        "nodes",
    )
    sums = _member_sums(members, nodes).withColumnsRenamed(
        {"depth": "e_depth", "x1": "e1", "x2": "e2"}
    )
    above = running_in_groups(
        nodes,
        ["conv_id"],
        ["depth"],
        {"upto_leaves": F.sum("leaves"), "upto_saved": F.sum("saved")},
    )
    children = nodes.where("depth > 0").select(
        (F.col("depth") - 1).alias("depth"), F.col("q1").alias("x1"), F.col("q2").alias("x2")
    )
    counted = children.groupBy(*_NODE).agg(F.count("*").alias("n_children"))
    hashes = ids_hashed(members.where(ends_here).select(*_NODE, "conv_id"))
    full = materialize(
        above.join(sums, ["e_depth", "e1", "e2"])
        .join(counted, _NODE, "left")
        .join(hashes, _NODE, "left")
        .select(
            *_NODE,
            (F.col("depth") - 1).alias("_up"),
            "q1",
            "q2",
            "conv_id",
            "n_convs",
            F.coalesce("n_children", F.lit(0)).alias("n_children"),
            (F.col("all_leaves") - F.col("upto_leaves") + F.col("leaves")).alias("n_leaves"),
            (F.col("all_saved") - F.col("upto_saved") + F.col("saved")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"),
        ),
        "trie",
    )
    above_keys = ["_up", "q1", "q2"]
    tops = full.where("n_children > 0").select(
        F.col("depth").alias("_up"),
        F.col("x1").alias("q1"),
        F.col("x2").alias("q2"),
        F.col("conv_id").alias("parent_conv_id"),
        F.col("n_children").alias("_size"),
    )
    below = grouped_join(full.where("depth > 0"), tops, above_keys, "_size", full.count())
    root = full.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    return below.unionByName(root).select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        "ends_sha256",
    )


# DuckDB has no CRC-32: `steps` holds what each byte does to it, eight shifts long.
ORACLE_SQL = """
WITH steps AS (
  SELECT list(step ORDER BY byte) AS step FROM (
    SELECT byte, list_reduce(list_prepend(byte::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]),
             lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT)
                               ELSE x >> 1 END) AS step
    FROM range(256) t(byte))),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id
           ORDER BY turn NULLS FIRST, coalesce(role, ''),
             sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')))
           - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS turns FROM turns GROUP BY 1),
heads AS (
  SELECT conv_id, turns,
    xor(list_reduce(list_prepend(4294967295::BIGINT,
          list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
        lambda x, y: xor(x >> 8, step[1 + (xor(x, y) & 255)])), 4294967295::BIGINT) % 9 AS h
  FROM own, steps),
rebuilt AS (
  SELECT a.conv_id,
         list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS turns
  FROM heads a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5),
members AS (
  SELECT conv_id, len(turns) AS length, unnest(range(len(turns) + 1)) AS depth, turns FROM rebuilt),
nodes AS (
  SELECT depth, turns[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
         max(length) = depth AS leaf,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)
           FILTER (WHERE length = depth), '')) AS ends_sha256
  FROM members GROUP BY 1, 2),
tops AS (
  SELECT depth AS d, conv_id AS c, leaf, path, unnest(range(depth + 1)) AS depth,
         CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(path[depth].text) END AS saved
  FROM nodes),
sums AS (
  SELECT depth, path[1:depth] AS path, count(*) FILTER (WHERE leaf) AS n_leaves,
         sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE d = depth + 1) AS n_children
  FROM tops GROUP BY 1, 2)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves,
       s.saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.depth = n.depth AND s.path = n.path
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
"""
