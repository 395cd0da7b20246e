"""Quality rules on documents, and verdicts on hosts from their shrunken failure rates.

Each document is measured once. Per host and rule the failures are counted, the rates of all
hosts give the rule's Beta prior by the method of moments, and a host's rate is shrunk to it:
(failures + alpha) / (documents + alpha + beta). A host is rejected if a shrunken rate exceeds
the limit, and its documents with it, whatever they look like. A small host therefore needs
more than a few bad documents to be rejected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from wheeltrace.llm.common import known_small, text_slices, utf8
from wheeltrace.operators.scale import materialize, salted_join

WINDOW_WORDS = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
MAX_HOST_RATE = 0.5
# The prior counts for at least so many documents.
MIN_STRENGTH = 5.0
# A host verdict has about 50 bytes; more hosts than this are joined by shuffle.
BROADCAST_HOSTS = 100_000

_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MEASURES = T.StructType([T.StructField(name, T.LongType()) for name in _NAMES])
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(b"#*$%&|<>")] = True
# Bytes that begin a character of UTF-8.
_IS_FIRST = (np.arange(256) & 0xC0) != 0x80


def _repeated_words(words: list[bytes]) -> int:
    """Words that lie in an eight-word window which the text holds twice or more."""
    n = len(words) - WINDOW_WORDS + 1
    if n < 2:
        return 0
    held = np.empty(len(words), object)
    held[:] = words
    codes = pd.factorize(held)[0].astype(np.int64)
    # Codes of 2, 4 and 8 words: a window is the pair of its halves.
    for width in (1, 2, 4):
        pairs = codes[:-width] * (codes.max() + 1) + codes[width:]
        codes = pd.factorize(pairs)[0].astype(np.int64)
    repeated = (np.bincount(codes) > 1)[codes]
    if not repeated.any():
        return 0
    opened = np.zeros(len(words) + 1, np.int64)
    opened[:n] += repeated
    opened[WINDOW_WORDS : WINDOW_WORDS + n] -= repeated
    return int((np.cumsum(opened)[:-1] > 0).sum())


def _repeated_lines(data: bytes) -> int:
    lines = [line for line in data.split(b"\n") if line.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


@pandas_udf(_MEASURES)
def _measures(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for part in text_slices(texts):
        for text in texts.iloc[part]:
            data = utf8(text)
            words = data.split()
            held = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
            rows.append(
                (
                    len(words),
                    held[_IS_FIRST & ~_IS_SPACE].sum(),
                    held[_IS_SYMBOL].sum(),
                    _repeated_lines(data),
                    _repeated_words(words),
                )
            )
    return pd.DataFrame(rows, columns=list(_NAMES), dtype=np.int64)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of `docs`, and `quality`: a struct of the measures of the column `text`.

    Words are runs of characters other than ASCII white space; a null text has none. A column
    `quality` of the input is replaced.
    """
    return docs.withColumn("quality", _measures(text))


def rules() -> dict[str, Column]:
    """Named rules over the struct `quality`: true if the document fails."""
    q = F.col("quality")
    words = F.greatest(q["n_words"], F.lit(1))
    return {
        "few_words": q["n_words"] < MIN_WORDS,
        "repeated_words": 100 * q["n_repeat_words"] > MAX_REPEATED_PERCENT * q["n_words"],
        "symbols": 10 * q["n_symbols"] > q["n_words"],
        "repeated_lines": 10 * q["n_dup_lines"] > q["n_words"],
        "word_length": (q["word_chars"] < 2 * words) | (q["word_chars"] > 20 * words),
    }


def host_verdicts(stats: DataFrame, host: str, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: documents, the largest shrunken failure rate and `host_rejected`.

    Null hosts form no host. Counting is partly done before the shuffle, so a host that holds
    a third of all documents is no large group. Without variance between the hosts a rule's
    prior is MIN_STRENGTH documents at the common rate.
    """
    failing = rules()
    counts = (
        stats.where(F.col(host).isNotNull())
        .groupBy(host)
        .agg(
            F.count("*").alias("n"),
            *[F.count_if(failed).alias(name) for name, failed in failing.items()],
        )
    )
    counts = materialize(counts, "host-counts")
    # One row: the mean rate of each rule and its variance over the hosts.
    moments = counts.agg(
        *[(F.sum(name) / F.sum("n")).alias(f"{name}_mean") for name in failing],
        *[F.var_pop(F.col(name) / F.col("n")).alias(f"{name}_var") for name in failing],
        F.avg(1 / F.col("n")).alias("per_document"),
    ).first()
    rates = []
    for name in failing:
        mean, var = moments[f"{name}_mean"] or 0.0, moments[f"{name}_var"] or 0.0
        spread = mean * (1 - mean)
        # Rates of hosts that are all alike differ too, as their documents are a sample.
        var = max(var - spread * (moments["per_document"] or 0.0), 0.0)
        strength = max(spread / var - 1 if 0 < var < spread else 0.0, MIN_STRENGTH)
        rates.append((F.col(name) + mean * strength) / (F.col("n") + strength))
    return counts.select(
        host,
        F.col("n").alias("host_documents"),
        F.greatest(*rates).alias("host_rate"),
        (F.greatest(*rates) > max_rate).alias("host_rejected"),
    )


def judged(stats: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """`stats` (from `measured`, written here once) with its verdicts.

    Adds base_failed, host_rate, host_rejected and kept. Few words or many repeated words fail
    a document itself; the verdict of its host decides on the rest. Documents with a null host
    are judged on their own. Repeated rows are judged and counted one by one. An empty table
    stays empty. Columns of these names in the input are replaced.
    """
    own = ["base_failed", "host_documents", "host_rate", "host_rejected", "kept"]
    stats = materialize(stats.drop(*own), "measured")
    return with_verdicts(stats, host_verdicts(stats, host, max_rate), host)


def with_verdicts(stats: DataFrame, hosts: DataFrame, host: str) -> DataFrame:
    """`stats` with the verdicts of `hosts` (from `host_verdicts`) on its column `host`."""
    hosts = materialize(hosts, "host-verdicts").withColumnRenamed(hosts.columns[0], host)
    few = known_small(hosts, BROADCAST_HOSTS)
    if few is hosts:
        joined = salted_join(stats, hosts, [host], spread_by=["quality"])
    else:
        joined = stats.join(few, host, "left")
    failing = rules()
    base_failed = failing["few_words"] | failing["repeated_words"]
    joined = joined.withColumn("base_failed", base_failed).withColumn(
        "host_rejected", F.coalesce("host_rejected", F.lit(False))
    )
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
