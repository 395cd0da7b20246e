"""Quality classifier: an additive model with pairwise interactions over features of the text.

Each feature has a lookup table over bins, and so have the chosen pairs of features. Tables are
grown by cyclic boosting: round after round every feature in turn gets a small step from a tree
of three leaves on the current residuals, afterwards every pair one from a tree with one cut per
side. A score is the sum of the table entries, through the logistic function.

Features come from Spark expressions on the whole text. Training uses a bounded sample of the
labelled rows (MAX_TRAINING_ROWS), parted into bags that are fitted in parallel tasks on at most
that many rows each; the bags' tables are averaged.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from wheeltrace.operators.scale import materialize

MAX_TRAINING_ROWS = 40_000
BAGS = 4
BINS = 64
PAIR_BINS = 12
PAIRS = 10
ROUNDS = 250
PAIR_ROUNDS = 120
RATE = 0.08
MIN_LEAF = 15
DECISION = 0.3


def features(text: Column) -> dict[str, Column]:
    """Numbers that describe a text; a null text is an empty one."""
    text = F.coalesce(text, F.lit(""))
    chars = F.char_length(text)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.trim(line) != "")
    n_words, n_lines = F.size(words), F.size(lines)

    def per(amount: Column, base: Column) -> Column:
        return (amount / F.greatest(base, F.lit(1))).cast("double")

    def without(characters: str) -> Column:
        return chars - F.char_length(F.translate(text, characters, ""))

    distinct = F.size(F.array_distinct(words))
    lower = "abcdefghijklmnopqrstuvwxyz"
    return {
        "n_words": F.log1p(n_words.cast("double")),
        "words_per_line": F.log1p(per(n_words, n_lines)),
        "word_length": per(chars, n_words),
        "distinct_words": per(distinct, n_words),
        # Distinct words grow with the root of the text, roughly.
        "richness": per(distinct, F.sqrt(n_words)),
        "distinct_lines": per(F.size(F.array_distinct(lines)), n_lines),
        "upper": per(without(lower.upper()), chars),
        "lower": per(without(lower), chars),
        "digits": per(without("0123456789"), chars),
        "stops": per(without(".?"), n_words),
        "commas": per(without(",;:"), n_words),
        "shouts": per(without("!"), n_words),
        "symbols": per(without("#*$%&<>@/\\_=+~^"), n_words),
        "bars": per(without("|[]{}"), n_words),
        "long_words": per(F.size(F.filter(words, lambda w: F.char_length(w) > 12)), n_words),
        "short_words": per(F.size(F.filter(words, lambda w: F.char_length(w) < 4)), n_words),
    }


def _grow(bins: np.ndarray, sizes: list[int], labels: np.ndarray, seed: int) -> dict:
    """Tables of one bag: bins is (features, rows)."""
    n_features, n = bins.shape
    mean = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    margin = np.full(n, base)
    tables = [np.zeros(size) for size in sizes]

    def slopes():
        p = 1 / (1 + np.exp(-margin))
        return labels - p, p * (1 - p)

    def gain(g, h):
        return g * g / (h + 1.0)

    for _ in range(ROUNDS):
        for f in range(n_features):
            size = sizes[f]
            g, h = slopes()
            g = np.bincount(bins[f], g, size).cumsum()
            h = np.bincount(bins[f], h, size).cumsum()
            count = np.bincount(bins[f], minlength=size).cumsum()
            # Two cuts a <= b: leaves [0, a], (a, b], (b, end).
            a, b = np.triu_indices(size)
            middle = gain(g[b] - g[a], h[b] - h[a])
            value = gain(g[a], h[a]) + middle + gain(g[-1] - g[b], h[-1] - h[b])
            few = (count[a] < MIN_LEAF) | ((b > a) & (count[b] - count[a] < MIN_LEAF))
            few |= (b < size - 1) & (count[-1] - count[b] < MIN_LEAF)
            value = np.where(few, -1.0, value)
            best = int(value.argmax())
            if value[best] < 0:
                continue
            a, b = a[best], b[best]
            step = np.empty(size)
            step[: a + 1] = g[a] / (h[a] + 1.0)
            step[a + 1 : b + 1] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
            step[b + 1 :] = (g[-1] - g[b]) / (h[-1] - h[b] + 1.0)
            tables[f] += RATE * step
            margin += RATE * step[bins[f]]

    coarse = [(bins[f] * PAIR_BINS // sizes[f]).astype(np.int64) for f in range(n_features)]

    def quadrants(x, y, g, h):
        """Gain of the best cut per side, and the step table it gives."""
        cells = coarse[x] * PAIR_BINS + coarse[y]
        shape = (PAIR_BINS, PAIR_BINS)
        parts = []
        for values in (g, h):
            table = np.bincount(cells, values, PAIR_BINS * PAIR_BINS).reshape(shape)
            corner = table.cumsum(0).cumsum(1)
            low, left, total = corner[:, -1:], corner[-1:, :], corner[-1, -1]
            parts.append((corner, low - corner, left - corner, total - low - left + corner))
        value = sum(gain(a, b) for a, b in zip(*parts, strict=True))[:-1, :-1]
        i, j = np.unravel_index(value.argmax(), value.shape)
        leaf = [a[i, j] / (b[i, j] + 1.0) for a, b in zip(*parts, strict=True)]
        step = np.empty(shape)
        step[: i + 1, : j + 1], step[: i + 1, j + 1 :] = leaf[0], leaf[1]
        step[i + 1 :, : j + 1], step[i + 1 :, j + 1 :] = leaf[2], leaf[3]
        return float(value[i, j]), step, cells

    g, h = slopes()
    ranked = sorted(
        ((quadrants(x, y, g, h)[0], x, y) for x in range(n_features) for y in range(x)),
        reverse=True,
    )
    pairs = [(x, y) for _, x, y in ranked[:PAIRS]]
    pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (x, y) in enumerate(pairs):
            _, step, cells = quadrants(x, y, *slopes())
            pair_tables[k] += RATE * step
            margin += RATE * step.reshape(-1)[cells]
    return {
        "base": base,
        "tables": [t.tolist() for t in tables],
        "pairs": [[x, y, t.tolist()] for (x, y), t in zip(pairs, pair_tables, strict=True)],
    }


def _binned(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, v, side="right") for c, v in zip(cuts, values, strict=True)])


def fit(rows: DataFrame, names: list[str], label: str, key: str) -> dict:
    """The model from labelled `rows`: cut points, base value, tables.

    At most about MAX_TRAINING_ROWS rows are used, chosen by a hash of `key`; rows without a
    label are left out. Without both labels every score is the share of label 1, or 0.5.
    """
    rows = rows.where(F.col(label).isNotNull())
    counts = rows.agg(F.count("*").alias("n"), F.avg(label).alias("mean")).first()
    empty = {"names": names, "cuts": [[] for _ in names], "tables": [[0.0] for _ in names]}
    if not counts["n"] or counts["mean"] in (0.0, 1.0):
        mean = 0.5 if not counts["n"] else min(max(counts["mean"], 1e-3), 1 - 1e-3)
        return empty | {"base": float(np.log(mean / (1 - mean))), "pairs": []}
    place = F.xxhash64(F.lit("sample"), key)
    share = min(1.0, MAX_TRAINING_ROWS / counts["n"])
    chosen = rows.where(F.pmod(place, F.lit(1_000_000)) < int(share * 1_000_000))
    chosen = chosen.withColumn("_bag", F.pmod(F.xxhash64(F.lit("bag"), key), F.lit(BAGS)))
    chosen = materialize(chosen.select("_bag", F.col(label).alias("_label"), *names), "training")
    shares = [k / BINS for k in range(1, BINS)]
    cuts = [sorted(set(c)) for c in chosen.approxQuantile(names, shares, 0.002)]

    def bag(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        points = [np.array(c) for c in cuts]
        bins = _binned(frame[names].to_numpy().T, points)
        labels = frame["_label"].to_numpy(np.float64)
        grown = _grow(bins, [len(c) + 1 for c in points], labels, int(key[0]))
        return pd.DataFrame({"model": [json.dumps(grown)]})

    # A bag leaves out its share of the rows, so each has three quarters of the sample.
    bags = chosen.withColumn(
        "_in", F.explode(F.array(*[F.lit(k) for k in range(BAGS)]))
    ).where("_in != _bag")
    grown = [
        json.loads(row["model"])
        for row in bags.groupBy("_in").applyInPandas(bag, "model string").collect()
    ]
    tables = [np.mean([m["tables"][f] for m in grown], axis=0).tolist() for f in range(len(names))]
    pairs: dict[tuple[int, int], np.ndarray] = {}
    for model in grown:
        for x, y, table in model["pairs"]:
            pairs[x, y] = pairs.get((x, y), 0) + np.array(table) / len(grown)
    return {
        "names": names,
        "cuts": cuts,
        "base": float(np.mean([m["base"] for m in grown])),
        "tables": tables,
        "pairs": [[x, y, t.tolist()] for (x, y), t in sorted(pairs.items())],
    }


def scorer(model: dict):
    """A column function from the features, in order, to a score between 0 and 1."""

    @pandas_udf("double")
    def score(values: pd.DataFrame) -> pd.Series:
        bins = _binned(values.to_numpy(np.float64).T, [np.array(c) for c in model["cuts"]])
        margin = np.full(len(values), model["base"])
        for own, entries in zip(bins, model["tables"], strict=True):
            margin += np.array(entries)[own]
        sizes = [len(c) + 1 for c in model["cuts"]]
        for x, y, entries in model["pairs"]:
            left = bins[x] * PAIR_BINS // sizes[x]
            margin += np.array(entries)[left, bins[y] * PAIR_BINS // sizes[y]]
        return pd.Series(1 / (1 + np.exp(-margin)))

    return lambda names: score(F.struct(*names))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of `docs` (doc_id, text).

    Rows whose crc32(doc_id as text) is divisible by 5 are held out: their labels (doc_id,
    quality) are not learnt from. A null doc_id is not held out and has no label. Several
    labels of one doc_id count as their majority, null labels not at all. Null and empty texts
    get the score of an empty text; repeated rows get equal scores and each counts in training
    if labelled. Empty tables are fine; other columns are ignored.
    """
    described = features(F.col("text"))
    names = list(described)
    rows = materialize(
        docs.select("doc_id", *[c.alias(name) for name, c in described.items()]), "features"
    )
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    known = (
        labels.where("quality IS NOT NULL")
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("double").alias("_quality"))
    )
    training = rows.where(~held_out).join(known, "doc_id")
    model = fit(training, names, "_quality", "doc_id")
    score = scorer(model)(names)
    return rows.select("doc_id", held_out.alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= DECISION).cast("int")
    )
