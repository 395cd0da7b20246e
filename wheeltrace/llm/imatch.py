"""I-Match fingerprints with several randomised lexicons.

The lexicon is the terms of a middle band of inverse document frequency. Each of the randomised
lexicons is a random part of it, and each term is in one of them; a document's fingerprint has,
for each, the hash of its sorted distinct terms in that part. Small edits change few terms and so
leave most hashes as they are. A document without terms of the band is described by all its
terms, dealt to the lexicons alike, so that unlike documents do not look the same.

Document frequencies are counted over all documents. A term of the band is in at least
MIN_SHARE of the documents, so the band has at most (terms per document) / MIN_SHARE terms
however many documents there are; that bound, and MAX_LEXICON, are what allows broadcasting it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from wheeltrace.llm.common import arrow_slices, mix, text_slices, utf8
from wheeltrace.operators.scale import materialize

MIN_SHARE = 0.0005
MAX_SHARE = 0.2
LEXICONS = 128
# Hexadecimal digits of a hash in a fingerprint.
HASH_DIGITS = 4
# 8 bytes per term of the lexicon.
MAX_LEXICON = 4_000_000

# Bytes of ASCII letters in lower case, digits and all of UTF-8's other characters; the rest
# parts terms.
_TERM_BYTES = bytes(
    b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower()
)


def term_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct terms of each text, sorted, text after text, and their numbers."""
    terms: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for row, text in enumerate(texts):
        own = list(set(utf8(text).translate(_TERM_BYTES).split()))
        counts[row] = len(own)
        terms += own
    if not terms:
        return np.zeros(0, np.uint64), counts
    held = np.empty(len(terms), object)
    held[:] = terms
    codes, distinct = pd.factorize(held)
    hashes = pd.util.hash_array(distinct, categorize=False)[codes]
    order = np.lexsort((hashes, np.repeat(np.arange(len(texts)), counts)))
    return hashes[order], counts


def _term_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        # Documents that hold a term, counted per batch before anything is shuffled.
        terms, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for part in text_slices(batch["text"]):
            found = np.sort(term_hashes(batch["text"].iloc[part].tolist())[0])
            both = np.concatenate([terms, found])
            weights = np.concatenate([counts, np.ones(len(found), np.int64)])
            codes, terms = pd.factorize(both)
            counts = np.bincount(codes, weights=weights, minlength=len(terms)).astype(np.int64)
        yield pd.DataFrame({"term": terms.view(np.int64), "documents": counts})


def lexicon(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the terms whose share of documents lies in the band.

    With more than MAX_LEXICON of these, which takes texts of thousands of distinct terms each,
    the band begins higher: its MAX_LEXICON most frequent terms are the lexicon.
    """
    total = docs.count()
    if total == 0:
        return np.zeros(0, np.uint64)
    band = (
        docs.select("text")
        .mapInPandas(_term_counts, "term bigint, documents bigint")
        .groupBy("term")
        .agg(F.sum("documents").alias("documents"))
        .where(F.col("documents").between(max(2, MIN_SHARE * total), MAX_SHARE * total))
    )
    band = materialize(band, "lexicon")
    if band.count() > MAX_LEXICON:
        band = band.orderBy(F.desc("documents"), "term").limit(MAX_LEXICON)
    return np.sort(band.select("term").toArrow()["term"].to_numpy().view(np.uint64))


def _fingerprints(texts: list, terms: np.ndarray) -> np.ndarray:
    """(texts, lexicons) hashes; 0 where a text has no term in a lexicon.

    A text without terms of the band has all its terms dealt to the lexicons instead, one
    without any term but not blank itself as a term.
    """
    hashes, counts = term_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    bare = [(row, utf8(texts[row]).strip()) for row in np.nonzero(counts == 0)[0]]
    bare = [(row, data) for row, data in bare if data]
    if bare:
        whole = np.empty(len(bare), object)
        whole[:] = [data for _, data in bare]
        hashes = np.append(hashes, pd.util.hash_array(whole, categorize=False))
        owner = np.append(owner, [row for row, _ in bare])
    known = np.zeros(len(hashes), bool)
    if len(terms):
        place = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
        known = terms[place] == hashes
    used = known | (np.bincount(owner[known], minlength=len(texts)) == 0)[owner]
    hashes, owner = hashes[used], owner[used]
    part = (mix(hashes + np.uint64(1)) >> np.uint64(32)).astype(np.int64) % LEXICONS
    prints = np.zeros((len(texts), LEXICONS), np.uint64)
    # Terms are distinct, so a sum of mixed hashes stands for their sorted sequence.
    np.add.at(prints, (owner, part), mix(hashes + np.uint64(2)))
    return prints


def _text(prints: np.ndarray) -> list[str]:
    digits = HASH_DIGITS
    short = prints >> np.uint64(64 - 4 * digits)
    # Zero means no term.
    short[(short == 0) & (prints != 0)] = 1
    return ["".join(f"{v:0{digits}x}" for v in row) for row in short.tolist()]


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """Share of equal hashes among the lexicons in which either text has terms; 1 if both are blank."""
    sides = [
        np.frombuffer("".join(side).encode(), np.uint8).reshape(-1, LEXICONS, HASH_DIGITS)
        for side in (left, right)
    ]
    used = ((sides[0] != ord("0")) | (sides[1] != ord("0"))).any(axis=2).sum(axis=1)
    same = (sides[0] == sides[1]).all(axis=2).sum(axis=1) - (LEXICONS - used)
    return np.where(used == 0, 1.0, same / np.maximum(used, 1))


def fingerprinter(docs: DataFrame):
    """A column function from texts to fingerprints under the lexicon of `docs.text`.

    Equal texts have equal fingerprints. Only null, empty and blank texts have that of no terms
    (all zeros). Repeated rows count one by one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(lexicon(docs))

    @pandas_udf("string")
    def fingerprint(texts: pd.Series) -> pd.Series:
        rows: list[str] = []
        for part in text_slices(texts):
            rows += _text(_fingerprints(texts.iloc[part].tolist(), sent.value))
        return pd.Series(rows, dtype=object)

    return fingerprint


# `part` numbers the ranges of doc_ids; `place` is first, last, both or null for a row that has
# its neighbour in its range; only first and last rows carry their text.
_PLACED = (
    "doc_id string, part bigint, place string, text string, n_chars bigint, edited_sha256 string, "
    "fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
)
_REPORT = (
    "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
    "near_next",
)


def edited_text(text: str, following: str) -> str:
    """The text with its second half replaced by the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _judge(texts: list[str], following: list[str], terms: np.ndarray) -> dict[str, list]:
    """The report on texts next to the texts that follow them."""
    edited = [edited_text(a, b) for a, b in zip(texts, following, strict=True)]
    own, after, changed = (
        _text(_fingerprints(side, terms)) for side in (texts, following, edited)
    )
    return {
        "n_chars": [len(text) for text in texts],
        "edited_sha256": [hashlib.sha256(utf8(text)).hexdigest() for text in edited],
        # Stored as bytes, half as long as the hexadecimal text.
        "fingerprint": [bytes.fromhex(prints) for prints in own],
        "edited_fingerprint": [bytes.fromhex(prints) for prints in changed],
        "near_edited": likeness(own, changed).tolist(),
        "near_next": likeness(own, after).tolist(),
    }


def _in_ranges(terms):
    """Judge all rows of a range but its last, which waits for the next range's first row."""
    names = [part.split()[0] for part in _PLACED.split(", ")]

    def run(batches: Iterator) -> Iterator:
        part = TaskContext.get().partitionId()
        waiting, first = None, True
        for batch in batches:
            for piece in arrow_slices(batch, ["text"]):
                rows = list(zip(*(piece.column(n).to_pylist() for n in ("doc_id", "text")), strict=True))
                if waiting is not None:
                    rows.insert(0, waiting)
                waiting = rows.pop()
                if not rows:
                    continue
                ids, texts = [r[0] for r in rows], [r[1] for r in rows]
                columns = {"doc_id": ids, "part": [part] * len(ids)}
                columns["place"] = ["first" if first and not k else None for k in range(len(ids))]
                columns["text"] = [texts[0] if first and not k else None for k in range(len(ids))]
                first = False
                columns |= _judge(texts, [*texts[1:], waiting[1]], terms.value)
                yield pa.RecordBatch.from_pydict(columns, schema=_arrow_schema(_PLACED))
        if waiting is not None:
            row = dict.fromkeys(names)
            row |= {"doc_id": waiting[0], "part": part, "text": waiting[1]}
            row["place"] = "both" if first else "last"
            yield pa.RecordBatch.from_pylist([row], schema=_arrow_schema(_PLACED))

    return run


def _arrow_schema(spec: str) -> pa.Schema:
    kinds = {
        "bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary()
    }
    return pa.schema([(p.split()[0], kinds[p.split()[1]]) for p in spec.split(", ")])


def _at_edges(terms):
    """Judge the last rows of the ranges next to the first texts of the next ones."""

    def run(batches: Iterator) -> Iterator:
        schema = _arrow_schema(_PLACED)
        names = [n for n in schema.names if n in _REPORT]
        schema = pa.schema([schema.field(n) for n in names])
        for batch in batches:
            for piece in arrow_slices(batch, ["text", "following"]):
                columns = {"doc_id": piece.column("doc_id").to_pylist()}
                sides = (piece.column(n).to_pylist() for n in ("text", "following"))
                columns |= _judge(*sides, terms.value)
                yield pa.RecordBatch.from_pydict(columns, schema=schema)

    return run


def edit_report(docs: DataFrame, range_bytes: int = 32 << 20) -> DataFrame:
    """Every row of `docs` (doc_id, text), and how alike its fingerprint is to two others.

    The text is compared with its edited text, in which the start of the next document takes
    the place of the second half, and with the next document. Columns: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Next is by falling doc_id; the first follows the last. Null doc_ids come last, rows of one
    doc_id (or none) in the order of their texts' hashes. Null texts count as empty. Other
    columns are not read. An empty table gives an empty result; a single row follows itself.

    Texts are range-partitioned once and judged there in bounded slices; no text leaves the
    task but the first and last of each range, which are joined afterwards.
    """
    terms = docs.sparkSession.sparkContext.broadcast(lexicon(docs))
    text = F.coalesce("text", F.lit(""))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    rows = docs.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        text.alias("text"),
        F.col("doc_id").alias("_key"),
        F.xxhash64(text).alias("_hash"),
        # Parts equal rows, which may be many.
        F.monotonically_increasing_id().alias("_row"),
    )
    order = [F.desc_nulls_last("_key"), "_hash", "_row"]
    placed = materialize(
        rows.repartitionByRange(total // range_bytes + 1, *order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
        .mapInArrow(_in_ranges(terms), _PLACED),
        "judged-texts",
    )
    edges = placed.where("place IS NOT NULL")
    starts = edges.where("place IN ('first', 'both')")
    ends = edges.where("place IN ('last', 'both')").select("doc_id", "part", "text")
    # One row per range, without texts.
    numbers = starts.select("part", F.lit(1).alias("_one"))
    in_order = Window.partitionBy("_one").orderBy("part")
    following = numbers.select(
        "part",
        F.coalesce(F.lead("part").over(in_order), F.first("part").over(in_order)).alias("_next"),
    )
    pairs = ends.join(following, "part").join(
        starts.select(F.col("part").alias("_next"), F.col("text").alias("following")), "_next"
    )
    spec = ", ".join(p for p in _PLACED.split(", ") if p.split()[0] in _REPORT)
    last = pairs.select("doc_id", "text", "following").mapInArrow(_at_edges(terms), spec)
    inner = placed.where("place IS NULL OR place = 'first'").select(*_REPORT)
    return inner.unionByName(last).withColumns(
        {
            "doc_id": F.col("doc_id").cast("bigint"),
            "fingerprint": F.lower(F.hex("fingerprint")),
            "edited_fingerprint": F.lower(F.hex("edited_fingerprint")),
        }
    )
