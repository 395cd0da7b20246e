"""Helpers shared by the operators: words, hashes, bounded slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wheeltrace.operators.scale import known_small  # noqa: F401

# Texts are handled in slices of about this many characters, so that the memory of a task
# depends on the longest single text and not on the size of a batch or partition.
SLICE_CHARS = 1 << 20
BATCH_ROWS = 500

_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(texts: pd.Series, limit: int = SLICE_CHARS) -> Iterator[slice]:
    """Consecutive row ranges of at most `limit` characters, or of one longer text."""
    start, held = 0, 0
    for row, text in enumerate(texts):
        size = len(text) if isinstance(text, str) else 0
        if held and held + size > limit:
            yield slice(start, row)
            start, held = row, 0
        held += size
    if start < len(texts):
        yield slice(start, len(texts))


def small_batches(spark: SparkSession) -> None:
    """Have Spark hand texts to Python in batches of at most BATCH_ROWS rows, in this session.

    A worker holds a batch two or three times over. With Spark's 10,000 rows that is several
    hundred megabytes of ordinary documents in each worker of an executor.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def arrow_slices(batch, names: list[str], limit: int = SLICE_CHARS):
    """Consecutive parts of an Arrow batch with at most `limit` bytes in the named texts.

    Only such a part is turned into Python objects at a time; a part may be one longer row.
    """
    import pyarrow.compute as pc

    sizes = sum(
        pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
        for name in names
    )
    start, held = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def map_with_ids(docs: DataFrame, columns: list, function, schema: str) -> DataFrame:
    """mapInPandas over doc_id and `columns`; `schema` begins with doc_id bigint.

    Ids travel as text: a batch that holds a null id would turn long ids into floats, which
    are not exact above 2^53.
    """
    sent = docs.select(F.col("doc_id").cast("string").alias("doc_id"), *columns)
    found = sent.mapInPandas(function, schema.replace("doc_id bigint", "doc_id string", 1))
    return found.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def utf8(text) -> bytes:
    """UTF-8 bytes of a text, none for null."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    values = (values ^ (values >> np.uint64(30))) * _MIX_1
    values = (values ^ (values >> np.uint64(27))) * _MIX_2
    return values ^ (values >> np.uint64(31))


def word_lists(texts, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, and the number of words of each text.

    Words are runs of bytes other than ASCII white space, which bytes.split() splits at.
    """
    words: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for row, text in enumerate(texts):
        data = utf8(text)
        own = (data.lower() if lower else data).split()
        counts[row] = len(own)
        words += own
    if not words:
        return np.zeros(0, np.uint64), counts
    held = np.empty(len(words), object)
    held[:] = words
    codes, distinct = pd.factorize(held)
    return pd.util.hash_array(distinct, categorize=False)[codes], counts


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)
