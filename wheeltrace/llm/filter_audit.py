"""Audit of filters in every order: who removes what, who would have, and what it costs.

Each filter's failing rows are stored as one table of ids. Everything else is joins between
these tables: left-anti for the survivors of a set of filters applied before, left-semi for
removals, redundancies and label losses. A prefix of an order matters only as a set, so five
filters have 32 prefixes; all are joined at once as (id, prefix) rows that a fixed list of 32
makes of each failing id after the ids were dealt out.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wheeltrace.operators.scale import grouped_join, materialize

FILTERS = "ABCDE"
_ALL = (1 << len(FILTERS)) - 1
_WORD_BREAK = r"[\x20\x09-\x0D]+"


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def measured(docs: DataFrame) -> DataFrame:
    """(_row, doc_id, part, verdicts of the filters A to D, _digest) of every row, written.

    A: under 200 words; B: fewer than half of the words distinct; C: over 2 % of the
    characters are A-Z; D: holds one of #$%&*|. A null text is empty and fails A only; a null
    source is the part ''. `_digest` stands for the text in filter E.
    """
    texts = docs.select(
        F.col("doc_id").alias("doc_id"),
        F.coalesce("source", F.lit("")).alias("part"),
        F.coalesce("text", F.lit("")).alias("_text"),
    )
    split = texts.withColumn("_words", F.array_remove(F.split("_text", _WORD_BREAK), ""))
    n_words = F.size("_words")
    return materialize(
        split.select(
            F.monotonically_increasing_id().alias("_row"),
            "doc_id",
            "part",
            (n_words < 200).alias("A"),
            (F.size(F.array_distinct("_words")) * 100 < n_words * 50).alias("B"),
            (
                F.regexp_count("_text", F.lit("[A-Z]")) * 100
                > F.char_length("_text").cast("bigint") * 2
            ).alias("C"),
            F.col("_text").rlike(r"[#$%&*|]").alias("D"),
            F.unhex(F.sha2("_text", 256)).alias("_digest"),
        ),
        "filter-measures",
    )


def repeated_texts(rows: DataFrame) -> DataFrame:
    """_row of every row whose text a smaller doc_id holds too; null is above every doc_id."""
    groups = materialize(
        rows.groupBy("_digest")
        .agg(F.count("*").alias("_size"), F.min("doc_id").alias("_first"))
        .where("_size > 1"),
        "text-groups",
    )
    held = rows.select("_row", "doc_id", "_digest")
    joined = grouped_join(held, groups, ["_digest"], "_size", rows.count())
    return joined.where(
        "_first IS NOT NULL AND (doc_id IS NULL OR _first < doc_id)"
    ).select("_row")


def failing_ids(rows: DataFrame) -> dict[str, DataFrame]:
    """One written table of ids (_row) per filter: the rows that fail it."""
    tables = {letter: rows.where(letter).select("_row") for letter in "ABCD"}
    tables["E"] = repeated_texts(rows)
    return {
        letter: materialize(frame, f"fails-{letter}") for letter, frame in tables.items()
    }


def _prefixes(condition) -> Column:
    return F.explode(F.array(*[F.lit(s) for s in range(_ALL + 1) if condition(s)]))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step: what its filter does there.

    kept: rows left after the step; removed: rows it takes; redundant: rows failing it that
    were gone already; unique_fails: rows failing it alone; good_lost, toxic_lost: labelled
    rows among the removed; shapley: its removals summed over all 120 orders. Zeros where
    nothing happens. Labels go by doc_id: a row counts as
    good (toxic) if any label row of its doc_id says so; a null doc_id has no label. Repeated
    rows count each. An empty table has no parts and gives no rows. Other columns are not read.
    """
    rows = measured(docs)
    store = failing_ids(rows)
    fails = None
    for letter, frame in store.items():
        tagged = frame.select("_row", F.lit(_bit(letter)).alias("bit"))
        fails = tagged if fails is None else fails.unionByName(tagged)
    # Every join below is on _row: the ids are dealt out by it once, then repeated per prefix.
    dealt = fails.repartition("_row")
    other = dealt.select(F.col("_row").alias("_id"), F.col("bit").alias("_bit"))
    applied = F.col("prefix").bitwiseAND(F.col("_bit")) != 0
    hit = (F.col("_row") == F.col("_id")) & applied

    parts = rows.select("_row", "part")
    dirty = dealt.select("_row").distinct().withColumn("prefix", _prefixes(lambda s: True))
    survivors = dirty.join(other, hit, "left_anti").select("_row", "prefix")
    clean = parts.join(fails.select("_row"), "_row", "left_anti")
    # A filter's own bit is never in a prefix before it.
    tried = dealt.withColumn("prefix", _prefixes(lambda s: True)).where(
        F.col("prefix").bitwiseAND(F.col("bit")) == 0
    )
    removed = tried.join(other, hit, "left_anti")
    redundant = tried.join(other, hit, "left_semi")

    labelled = rows.where("doc_id IS NOT NULL").select("_row", "doc_id")

    def marked(column: str) -> DataFrame:
        chosen = labels.where(f"doc_id IS NOT NULL AND {column} = 1").select("doc_id")
        return labelled.join(chosen, "doc_id", "left_semi").select("_row")

    cells = None
    lost = {
        "removed": removed,
        "redundant": redundant,
        "good_lost": removed.join(marked("quality"), "_row", "left_semi"),
        "toxic_lost": removed.join(marked("toxic"), "_row", "left_semi"),
        "kept": survivors.withColumn("bit", F.lit(0)),
    }
    for kind, frame in lost.items():
        counted = (
            frame.join(parts, "_row")
            .groupBy("part", "bit", "prefix")
            .agg(F.count("*").alias("n"))
            .withColumn("kind", F.lit(kind))
        )
        cells = counted if cells is None else cells.unionByName(counted)
    return _steps(rows, clean, cells)


def _steps(rows: DataFrame, clean: DataFrame, cells: DataFrame) -> DataFrame:
    """Counts per part, order and step from the counts per part, filter and prefix set."""
    key = F.concat_ws(":", "kind", "bit", "prefix")
    # At most 5 x 16 cells of four kinds and 32 of `kept` meet in one part.
    maps = cells.groupBy("part").agg(
        F.map_from_entries(F.collect_list(F.struct(key, "n"))).alias("cells")
    )
    untouched = clean.groupBy("part").agg(F.count("*").alias("untouched"))
    parts = (
        rows.select("part")
        .distinct()
        .join(untouched, "part", "left")
        .join(maps, "part", "left")
        .select(
            "part",
            F.coalesce("untouched", F.lit(0)).alias("untouched"),
            F.coalesce("cells", F.create_map().cast("map<string,bigint>")).alias("cells"),
        )
    )
    orders = F.array(*[F.lit("".join(order)) for order in permutations(FILTERS)])
    steps = parts.select("*", F.explode(orders).alias("filter_order")).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step")
    )
    own = F.element_at(_letter_bits(), F.substring("filter_order", F.col("step"), F.lit(1)))
    before = sum(
        F.when(F.instr(F.col("filter_order"), F.lit(f)) < F.col("step"), _bit(f)).otherwise(0)
        for f in FILTERS
    )
    steps = steps.select("*", own.alias("bit"), before.alias("prefix"))

    def cell(kind: str, bit: Column, prefix: Column) -> Column:
        place = F.concat_ws(":", F.lit(kind), bit, prefix)
        return F.coalesce(F.try_element_at("cells", place), F.lit(0))

    bit, prefix = F.col("bit"), F.col("prefix")
    shapley = sum(
        F.when(
            F.lit(s).bitwiseAND(bit) == 0,
            cell("removed", bit, F.lit(s)) * _orders_with_prefix(s),
        ).otherwise(0)
        for s in range(_ALL + 1)
    )
    return steps.select(
        "part",
        "filter_order",
        "step",
        (F.col("untouched") + cell("kept", F.lit(0), bit + prefix)).alias("kept"),
        cell("removed", bit, prefix).alias("removed"),
        cell("redundant", bit, prefix).alias("redundant"),
        cell("removed", bit, F.lit(_ALL) - bit).alias("unique_fails"),
        cell("good_lost", bit, prefix).alias("good_lost"),
        cell("toxic_lost", bit, prefix).alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def _letter_bits() -> Column:
    return F.create_map(*[F.lit(v) for f in FILTERS for v in (f, _bit(f))])


def _orders_with_prefix(members: int) -> int:
    """Orders in which exactly these filters, of all but one, come before that one."""
    n = members.bit_count()
    return factorial(n) * factorial(max(len(FILTERS) - 1 - n, 0))


_CASES = " + ".join(f"CASE WHEN {f} THEN {_bit(f)} ELSE 0 END" for f in FILTERS)
_BEFORE = " + ".join(
    f"CASE WHEN instr(filter_order, '{f}') < step THEN {_bit(f)} ELSE 0 END" for f in FILTERS
)

ORACLE_SQL = rf"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
judged AS (
  SELECT doc_id, part, len(words) < 200 AS A,
         100 * len(list_distinct(words)) < 50 * len(words) AS B,
         100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS C,
         regexp_matches(text, '[#$%&*|]') AS D,
         coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false) AS E
  FROM texts),
marked AS (
  SELECT part, {_CASES} AS mask,
         doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good,
         doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic
  FROM judged),
masks AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good,
         count(*) FILTER (WHERE toxic) AS toxic
  FROM marked GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (
  SELECT filter_order, step, {_BEFORE} AS before,
         1 << (ascii(substr(filter_order, step, 1)) - 65) AS own
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5])::INT AS step)),
counted AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & before <> 0 AND mask & own <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN toxic ELSE 0 END)::BIGINT
      AS toxic_lost
  FROM masks, steps GROUP BY ALL)
SELECT * EXCLUDE (own), sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley
FROM counted
"""
