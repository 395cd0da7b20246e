"""Exact duplicates by progressive refinement: length, prefix hash, full hash.

Texts are equal when they are identical after deleting ASCII white space. A text that shares
its length with no other text is settled by that; of the rest, one that shares no prefix hash
with a text of its length is settled by that; only what remains is hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wheeltrace.operators.scale import grouped_join, materialize

# Characters of the normalised text that the prefix hash covers.
PREFIX_CHARS = 64

# Keys of undecided texts that are broadcast to the scan of the texts, 16 bytes each. With
# more, the scan hashes every text: moving texts to their keys would cost more than hashing.
BROADCAST_KEYS = 1 << 18

_KEY = ["_length", "_head"]
_SPACE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    bare = F.coalesce(text, F.lit(""))
    for space in _SPACE:
        bare = F.replace(bare, F.lit(space), F.lit(""))
    return bare


def _keyed(docs: DataFrame, *kept: Column) -> DataFrame:
    """Length and prefix hash of every text, next to the columns asked for."""
    bare = docs.select(*kept, normalised(F.col("text")).alias("_bare"))
    return bare.select(
        "*",
        F.char_length("_bare").alias("_length"),
        F.xxhash64(F.substring("_bare", 1, PREFIX_CHARS)).alias("_head"),
    )


def undecided(docs: DataFrame) -> DataFrame:
    """(_length, _head) of the texts that share both with another text.

    Lengths that occur once end their texts' part in this before prefixes are compared.
    """
    keys = materialize(_keyed(docs).select(*_KEY), "text-keys")
    lengths = keys.groupBy("_length").agg(F.count("*").alias("_n"))
    # Prefixes are counted first, as one length may hold very many rows.
    heads = keys.groupBy(*_KEY).agg(F.count("*").alias("_n"))
    open_lengths = lengths.where("_n > 1").select("_length")
    return heads.join(open_lengths, "_length", "left_semi").where("_n > 1").select(*_KEY)


def exact_duplicates(docs: DataFrame, all_hashes: bool = False) -> DataFrame:
    """One row per row of `docs` (doc_id, text): keep_id, group_size, kept.

    Of equal texts the row with the most code points in its original text stays, then the
    smallest doc_id (null last), then any one of rows that are alike in both. keep_id is the
    doc_id of that row, null if it has none. A null text counts as empty; empty texts are
    equal to each other. Other columns are not read. An empty table gives an empty result.

    `text_sha256` is the SHA-256 of the normalised text, null where length or prefix settled
    the text; with `all_hashes` it is given for every text, which decides nothing.
    """
    found = materialize(undecided(docs), "undecided-keys")
    few = len(found.select(F.lit(1)).take(BROADCAST_KEYS + 1)) <= BROADCAST_KEYS
    texts = _keyed(
        docs,
        F.col("doc_id"),
        F.char_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("_chars"),
    )
    whole = F.sha2("_bare", 256)
    if few:
        marked = texts.join(
            F.broadcast(found.withColumn("_open", F.lit(True))), _KEY, "left"
        ).withColumn("_hash", whole if all_hashes else F.when(F.col("_open"), whole))
    else:
        hashed = texts.withColumn("_hash", whole).drop("_bare")
        marked = hashed.join(found.withColumn("_open", F.lit(True)), _KEY, "left")
    rows = materialize(
        marked.select(
            F.monotonically_increasing_id().alias("_row"),
            "doc_id",
            "_chars",
            *_KEY,
            F.coalesce("_open", F.lit(False)).alias("_open"),
            F.col("_hash").alias("text_sha256"),
        ),
        "hashed-texts",
    )
    settled = rows.where("NOT _open").select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    rest = rows.where("_open")
    best = F.min(F.struct(-F.col("_chars"), F.col("doc_id").isNull(), "doc_id", "_row"))
    groups = materialize(
        rest.groupBy("_length", "_head", "text_sha256")
        .agg(F.count("*").alias("group_size"), best.alias("_best"))
        .select(
            "_length",
            "_head",
            "text_sha256",
            "group_size",
            F.col("group_size").alias("_size"),
            F.col("_best.doc_id").alias("keep_id"),
            F.col("_best._row").alias("_kept_row"),
        ),
        "equal-texts",
    )
    total = rows.count()
    joined = grouped_join(rest, groups, ["_length", "_head", "text_sha256"], "_size", total)
    return settled.unionByName(
        joined.select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("_row") == F.col("_kept_row")).alias("kept"),
            "text_sha256",
        )
    )


ORACLE_SQL = r"""
WITH bare AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
hashed AS (SELECT doc_id, chars, sha256(norm) AS text_sha256 FROM bare)
SELECT doc_id,
       first_value(doc_id) OVER best AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER best = 1 AS kept,
       text_sha256
FROM hashed
WINDOW best AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST)
"""
