"""The corpus pipeline: quality rules, near-duplicates, personal data, mixture, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as
Parquet and read again before the next one starts, so a lost executor never costs more than
the running stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wheeltrace.llm import minhash, mixing, packing, pii, quality_rules
from wheeltrace.llm.common import known_small, small_batches, table, tokenizer_path
from wheeltrace.operators.scale import materialize, stored_order

# A worker lives on with its words beside the stages of the next run, so it keeps some 100 MB of
# them and not the 560 of packing alone.
CACHED_WORDS = 150_000


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither fail the base rules nor come from a rejected host.

    Rows are judged one by one, repeated ones too; null texts have no words and go; a null
    source is no host. Hosts are judged on measures alone; a second pass over the texts, whose
    columns carry names of their own meanwhile, applies the verdicts. Empty stays empty.
    """
    small_batches(spark)
    stats = quality_rules.measured(docs.select("source", "text")).drop("text")
    hosts = quality_rules.host_verdicts(materialize(stats, "measured"), "source")
    inner = {name: f"_in{k}" for k, name in enumerate(docs.columns)}
    renamed = docs.toDF(*inner.values())
    measured = quality_rules.measured(renamed, inner["text"])
    judged = quality_rules.with_verdicts(measured, hosts, inner["source"])
    return judged.where("kept").select(*[F.col(new).alias(old) for old, new in inner.items()])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the smallest doc_id, null last.

    Rows that share a doc_id, or have none, get a number of their own above all doc_ids and so
    are compared by their texts like all others. Texts without words are all kept. Empty stays
    empty.
    """
    small_batches(spark)
    row, own = "_pipeline_row", "_pipeline_id"
    numbered = materialize(
        docs.withColumn(row, F.monotonically_increasing_id()), "numbered-documents"
    )
    top = numbered.agg(F.max("doc_id")).first()[0] or 0
    repeated = materialize(
        numbered.groupBy("doc_id").count().where("doc_id IS NOT NULL AND count > 1"), "repeated"
    ).select(F.col("doc_id").alias("_repeated"))
    # Doc_ids that leave no room above them, as hashes may, are all replaced by the numbers.
    named = F.lit(top < 1 << 62) & F.col("doc_id").isNotNull() & F.col("_repeated").isNull()
    free = F.lit(max(top, 0) + 1 if top < 1 << 62 else 0)
    marked = numbered.join(
        known_small(repeated, 1 << 18), F.col("doc_id") == F.col("_repeated"), "left"
    ).withColumn(own, F.when(named, F.col("doc_id")).otherwise(free + F.col(row)))
    found = minhash.near_duplicates(marked.select(F.col(own).alias("doc_id"), "text"))
    groups = found.select(F.col("doc_id").alias(own), "component_id")
    named_rows = marked.select(row, own, "doc_id").join(groups, own)
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(row)))
    kept = named_rows.groupBy("component_id").agg(first.alias("first")).select(f"first.{row}")
    return numbered.join(kept, row, "left_semi").select(*docs.columns)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by placeholders.

    Null texts stay null; repeated rows are redacted alike; empty stays empty.
    """
    small_batches(spark)
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stored in the order of the mixture, which packing follows.

    A null source is a source of its own; repeated rows stay; empty stays empty.
    """
    return mixing.mixed_order(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2,048 tokens, in the order in which `docs` was stored.

    Null and empty texts are one token; repeated rows are packed one by one; empty stays empty.
    """
    small_batches(spark)
    return packing.pack(stored_order(docs), tokenizer_path(), cached_words=CACHED_WORDS)


STAGES = [
    ("quality_rules", keep_good),
    ("minhash_near_dedup", keep_one_of_each),
    ("pii", redact_pii),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

# Regular expressions over offsets, deadline scheduling and dynamic programming have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on the table `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
