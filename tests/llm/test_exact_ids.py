"""Ids above 2^53 next to a null id come back as they are, from every operator."""

import corpus_pipeline
import pytest

from wheeltrace.llm import (
    exact_dedup,
    imatch,
    minhash,
    mixing,
    packing,
    pii,
    quality_rules,
    sharding,
    suffix_dedup,
)
from wheeltrace.llm.common import tokenizer_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = " ".join(f"word{n}" for n in range(60))
IDS = [9007199254740993, 9007199254740995, (1 << 63) - 3, -(1 << 63) + 1]
ROWS = [(i, f"{WORDS} {n} " + f"own{n} " * 3, "en", "s", 0) for n, i in enumerate(IDS)]
ROWS += [(None, f"{WORDS} nobody's", "en", "s", 0)]
OPERATORS = {
    "imatch": imatch.edit_report,
    "minhash": minhash.near_duplicates,
    "mixing": mixing.mix,
    "packing": lambda docs: packing.pack(docs, tokenizer_path()),
    "pii": pii.find_pii,
    "quality_rules": quality_rules.measured,
    "sharding": lambda docs: sharding.shard(docs, shards=2),
    "suffix_dedup": suffix_dedup.cut_repeats,
    "exact_dedup": exact_dedup.exact_duplicates,
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).coalesce(1)


@pytest.mark.parametrize("name", list(OPERATORS))
def test_ids(docs, name):
    found = {row.doc_id for row in OPERATORS[name](docs).select("doc_id").collect()}
    assert found == {*IDS, None}


def test_components(docs):
    found = minhash.near_duplicates(docs).where("doc_id IS NOT NULL").collect()
    assert {row.component_id for row in found} == {min(IDS)}


def test_pipeline_keeps_one_row_of_each_group(spark):
    """Rows that share an id or have none are judged by their texts."""
    other = " ".join(f"other{n}" for n in range(60))
    rows = [
        *ROWS[:2], (7, other, "en", "s", 0), (7, f"{WORDS} seven", "en", "s", 0),
        (None, other + " x", "en", None, 0), (None, None, None, None, None), (8, " ", "en", "s", 0),
        (8, " ", "en", "s", 0),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    kept = corpus_pipeline.keep_one_of_each(spark, frame, "").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept) == sorted(
        [(False, 7, f"{WORDS} seven"), (False, 7, other), (True, 0, ""), (False, 8, " ")] + [(False, 8, " ")]
    )
