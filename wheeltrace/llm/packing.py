"""Pack documents into training windows, in order, by dynamic programming.

The tokens of a partition's documents form one stream. A window may end where a document or
a sentence ends. Among all ways to cut the stream into windows of at most 2,048 tokens the one
with the least padding plus penalties is chosen: cutting between sentences costs little, inside
an over-long sentence more. best(j) is the least of best(i) + padding(j - i) over the cuts i in
reach; as padding falls by one per token, best(i) + i stays comparable, and a queue with rising
values gives each minimum in constant time.

No shuffle: each input partition is packed where it is read, a stretch of tokens at a time,
and only the last window of a stretch may be short. A task that is run again packs alike.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from wheeltrace.llm.common import map_with_ids, text_slices
from wheeltrace.llm.tokens import CACHED_WORDS, word_encoder

WINDOW = 2048
END_OF_DOCUMENT = 1
SENTENCE_PENALTY = 2
SPLIT_PENALTY = 32
# Windows of these lengths need no padding either, but each such sequence costs a little;
# shorter ones are not worth a sequence.
FREE_LENGTHS = (512, 1024)
SHORT_PENALTY = 16
# The window that a stretch leaves open is closed after this many tokens.
STRETCH_TOKENS = 1 << 18
# Texts are tokenized in slices of this many characters for each word that a worker may keep: a
# word that comes again in its slice is looked up once.
SLICE_CHARS_A_WORD = 10

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, closed_by string"
)


def cut_candidates(
    ids: np.ndarray, doc_ends: np.ndarray, enders: np.ndarray, window: int = WINDOW
) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, in rising order, and the penalty of each.

    Document ends are free, ends of sentences cheap. A stretch without either is cut every
    `window` tokens.
    """
    free = np.zeros(len(ids) + 1, bool)
    free[doc_ends] = True
    free[0] = True
    soft = np.zeros(len(ids) + 1, bool)
    soft[1:] = enders[ids]
    cuts = np.nonzero(free | soft)[0]
    if cuts[-1] != len(ids):
        cuts = np.append(cuts, len(ids))
    gaps = np.diff(cuts)
    for k in np.nonzero(gaps > window)[0]:
        cuts = np.append(cuts, np.arange(cuts[k] + window, cuts[k + 1], window))
    cuts = np.sort(cuts)
    penalties = np.where(free[cuts], 0, np.where(soft[cuts], SENTENCE_PENALTY, SPLIT_PENALTY))
    return cuts, penalties


def choose_cuts(cuts: np.ndarray, penalties: np.ndarray, window: int = WINDOW) -> list[int]:
    """The ends of the windows of least padding plus penalties, from `cuts` (first is 0)."""
    n = len(cuts)
    places = cuts.tolist()
    costs = penalties.tolist()
    shorter = []
    for length in FREE_LENGTHS:
        if length < window:
            at = np.searchsorted(cuts, cuts - length)
            shorter.append(np.where(cuts[np.minimum(at, n - 1)] == cuts - length, at, -1).tolist())
    best, previous = [0] * n, [0] * n
    # Cuts in reach with rising best(i) + place(i); the first has the least.
    queue: deque[tuple[int, int]] = deque([(0, 0)])
    for j in range(1, n):
        place = places[j]
        while places[queue[0][1]] < place - window:
            queue.popleft()
        value, source = queue[0]
        value += window - place
        for exact in shorter:
            i = exact[j]
            if i >= 0 and best[i] + SHORT_PENALTY < value:
                value, source = best[i] + SHORT_PENALTY, i
        value += costs[j]
        best[j], previous[j] = value, source
        level = value + place
        while queue and queue[-1][0] >= level:
            queue.pop()
        queue.append((level, j))
    ends, j = [], n - 1
    while j > 0:
        ends.append(places[j])
        j = previous[j]
    return ends[::-1]


def _sentence_enders(tokenizer_path: str) -> np.ndarray:
    """Which ids end a sentence: those of punctuation that holds a full stop, ! or ?."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    enders = np.zeros(tokenizer.get_vocab_size() + 1, bool)
    for token, number in tokenizer.get_vocab().items():
        plain = token.removesuffix("</w>")
        enders[number] = bool(plain) and not plain.isalnum() and any(c in ".!?" for c in plain)
    return enders


def _pack(tokenizer_path: str, window: int, cached_words: int = CACHED_WORDS):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, enders = word_encoder(tokenizer_path, cached_words), _sentence_enders(tokenizer_path)
        sequence = TaskContext.get().partitionId() << 40
        # Open stretch: token arrays and, per document part, (doc_id, start, tokens, length).
        stretch: list[np.ndarray] = []
        parts: list[tuple[object, int, int, int]] = []
        held = 0

        def pieces(ids: np.ndarray, parts: list, last: bool):
            """Rows of the finished windows, and how many tokens they took."""
            nonlocal sequence
            ends_of_parts = np.cumsum([p[3] for p in parts])
            whole = np.array([p[1] + p[3] == p[2] for p in parts])
            cuts, penalties = cut_candidates(ids, ends_of_parts[whole], enders, window)
            ends = choose_cuts(cuts, penalties, window)
            if not last:
                # The last windows are decided with the text that follows.
                ends = ends[:-2]
            rows, at, part, begin = [], 0, 0, 0
            soft = dict(zip(cuts.tolist(), penalties.tolist(), strict=True))
            names = {0: "document", SENTENCE_PENALTY: "sentence"}
            for end in ends:
                first = at
                while at < end:
                    doc_id, start, tokens, length = parts[part]
                    stop = min(end, begin + length)
                    own = ids[at:stop]
                    rows.append(
                        (
                            doc_id,
                            start + at - begin,
                            stop - at,
                            zlib.crc32(own.astype("<u4").tobytes()),
                            tokens,
                            sequence,
                            at - first,
                            names.get(soft[end], "split"),
                        )
                    )
                    at = stop
                    if at == begin + length:
                        part, begin = part + 1, begin + length
                sequence += 1
            return rows, at

        def flush(last: bool):
            nonlocal stretch, parts, held
            ids = np.concatenate(stretch)
            rows, taken = pieces(ids, parts, last)
            rest, begin = [], 0
            for doc_id, start, tokens, length in parts:
                skip = min(max(taken - begin, 0), length)
                if skip < length:
                    rest.append((doc_id, start + skip, tokens, length - skip))
                begin += length
            stretch, parts, held = [ids[taken:]], rest, len(ids) - taken
            columns = [part.split()[0] for part in SCHEMA.split(", ")]
            return pd.DataFrame(rows, columns=columns)

        for batch in batches:
            numbers = batch["doc_id"].tolist()
            for part in text_slices(batch["text"], SLICE_CHARS_A_WORD * cached_words):
                ids, counts = encode(batch["text"].iloc[part].tolist())
                begin = 0
                for doc_id, n in zip(numbers[part], counts.tolist(), strict=True):
                    stretch += [ids[begin : begin + n], np.array([END_OF_DOCUMENT], np.uint32)]
                    begin += n
                    # Long documents enter whole; the stretch is cut below.
                    parts.append((doc_id, 0, n + 1, n + 1))
                    held += n + 1
                    if held >= STRETCH_TOKENS:
                        yield flush(last=False)
        if held:
            yield flush(last=True)

    return run


def pack(
    docs: DataFrame, tokenizer_path: str, window: int = WINDOW, cached_words: int = CACHED_WORDS
) -> DataFrame:
    """One row per piece of a document of `docs` (doc_id, text), see SCHEMA.

    A document's ids are those of its text without special tokens, then END_OF_DOCUMENT. Null
    and empty texts are that one id. Documents are packed in the order of the rows, repeated
    rows one by one, also with a null doc_id. Sequences are numbered from the partition number
    times 2^40. `closed_by` tells what the window of the piece ends with: document, sentence
    or split. An empty table gives an empty result; other columns are ignored. A Python worker keeps
    the ids of at most `cached_words` words, some 700 bytes each, also between its tasks.
    """
    return map_with_ids(docs, ["text"], _pack(tokenizer_path, window, cached_words), SCHEMA)
