"""Token ids of many texts at once, word by word."""

from __future__ import annotations

import os
import sys
import types
from collections.abc import Callable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Words remembered by a Python worker, about 700 bytes each; then it starts afresh.
CACHED_WORDS = 800_000

# A word of Latin letters and the punctuation after it: the tokenizer parts them too.
_SIMPLE = "^(?P<core>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[.,;:!?]*)$"


class _Ragged:
    """Lists of ids: `flat[begins[k] : begins[k] + lengths[k]]` is list k."""

    def __init__(self):
        self.flat = np.zeros(1 << 16, np.uint32)
        self.begins, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.rows = self.used = 0

    def extend(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        last, used = self.rows + len(lengths), self.used + len(flat)
        while last > len(self.begins):
            self.begins = np.append(self.begins, np.zeros_like(self.begins))
            self.lengths = np.append(self.lengths, np.zeros_like(self.lengths))
        while used > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        self.flat[self.used : used] = flat
        self.lengths[self.rows : last] = lengths
        self.begins[self.rows : last] = self.used + np.cumsum(lengths) - lengths
        self.rows, self.used = last, used

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists `rows`, one after the other, and the end of each."""
        sizes = self.lengths[rows]
        ends = np.cumsum(sizes)
        index = np.arange(int(ends[-1]) if len(ends) else 0)
        index += np.repeat(self.begins[rows] - (ends - sizes), sizes)
        return self.flat[index], ends


class _Words:
    """Ids of the words met so far, and of the pieces they consist of."""

    def __init__(self, path: str):
        self.most = CACHED_WORDS
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[n for token, n in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pieces: dict[str, int] = {}
        self.word_ids, self.piece_ids = _Ragged(), _Ragged()

    def _encode(self, texts: list[str]) -> None:
        """Append the ids of each text to the pieces."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = [e.ids for e in found]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))
        self.piece_ids.extend(flat, lengths)

    def _encode_letters(self, texts: list[str]) -> None:
        """The same for runs of letters, which are encoded as one text."""
        joined = self.tokenizer.encode_batch_fast([" ".join(texts)], add_special_tokens=False)
        ids = np.array(joined[0].ids, np.uint32)
        ends = np.nonzero(self.ends_word[ids])[0] + 1
        if len(ends) == len(texts):
            self.piece_ids.extend(ids, np.diff(ends, prepend=0))
        else:
            self._encode(texts)

    def _piece_numbers(self, pieces: pa.Array, encode: Callable[[list[str]], None]) -> np.ndarray:
        """Numbers of these pieces; those not met before are encoded."""
        coded = pieces.dictionary_encode()
        texts = coded.dictionary.to_pylist()
        numbers = np.fromiter(map(self.pieces.get, texts, repeat(-1)), np.int64, len(texts))
        missing = np.nonzero(numbers < 0)[0]
        if len(missing):
            new = [texts[k] for k in missing.tolist()]
            numbers[missing] = np.arange(len(missing)) + self.piece_ids.rows
            self.pieces.update(zip(new, numbers[missing].tolist(), strict=True))
            encode(new)
        return numbers[coded.indices.to_numpy()]

    def learn(self, words: list[bytes]) -> None:
        texts = pa.array(words, pa.binary()).cast(pa.string())
        split = pc.extract_regex(texts, _SIMPLE)
        simple = split.is_valid()
        split, others = split.filter(simple), texts.filter(pc.invert(simple))
        cores = self._piece_numbers(
            pc.utf8_lower(pc.struct_field(split, "core")), self._encode_letters
        )
        tails = self._piece_numbers(pc.struct_field(split, "tail"), self._encode)
        # Words of another kind are pieces without a name, as the words are remembered.
        rest = np.arange(len(others)) + self.piece_ids.rows
        self._encode(others.to_pylist())
        simple = simple.to_numpy(zero_copy_only=False)
        widths = np.where(simple, 2, 1)
        ends = np.cumsum(widths)
        pieces = np.zeros(int(widths.sum()), np.int64)
        pieces[ends[simple] - 2], pieces[ends[simple] - 1] = cores, tails
        pieces[ends[~simple] - 1] = rest
        flat, through = self.piece_ids.gather(pieces)
        first = self.word_ids.rows
        self.word_ids.extend(flat, np.diff(through[ends - 1], prepend=0))
        self.known.update(zip(words, range(first, first + len(words)), strict=True))

    def indices(self, words: np.ndarray) -> np.ndarray:
        """Numbers of distinct words."""
        found = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        if (found < 0).any():
            if len(self.known) + len(words) > self.most:
                self.forget()
                found[:] = -1
            missing = found < 0
            first = len(self.known)
            self.learn(words[missing].tolist())
            found[missing] = np.arange(first, first + int(missing.sum()))
        return found


def _worker_words(path: str) -> _Words:
    """The words of this Python worker, kept from task to task."""
    kept = sys.modules.setdefault("_words_of_worker", types.ModuleType("_words_of_worker"))
    if getattr(kept, "path", None) != path:
        kept.path, kept.words = path, _Words(path)
    return kept.words


def _split(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of all texts the place among the distinct ones, those, and words per text.

    Arrow splits at ASCII white space, as bytes.split() does, but leaves empty words at the
    ends of a text; only distinct words become Python objects.
    """
    whole = [text if isinstance(text, str) else "" for text in texts]
    parts = pc.ascii_split_whitespace(pa.array(whole, pa.large_string()))
    words = parts.flatten()
    real = pc.greater(pc.binary_length(words), 0)
    before = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))
    ends = np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False), dtype=np.int64)
    coded = words.filter(real).dictionary_encode()
    distinct = np.empty(len(coded.dictionary), object)
    distinct[:] = coded.dictionary.cast(pa.large_binary()).to_pylist()
    return coded.indices.to_numpy(), distinct, np.diff(before[ends], prepend=0)


def word_encoder(
    tokenizer_path: str, cached_words: int = CACHED_WORDS
) -> Callable[[list], tuple[np.ndarray, np.ndarray]]:
    """A function from texts to (ids of all texts, number of ids per text).

    The tokenizer drops white space and never merges across it, so each word is encoded
    when the worker first meets it, and its ids are put in place by position. The worker keeps
    at most `cached_words` words, or those of one call, from task to task.
    """
    known = _worker_words(tokenizer_path)
    known.most = cached_words

    def encode(texts: list) -> tuple[np.ndarray, np.ndarray]:
        codes, distinct, counts = _split(texts)
        if not len(codes):
            return np.zeros(0, np.uint32), counts
        numbers = known.indices(distinct)[codes]
        ids, ends = known.word_ids.gather(numbers)
        last = np.cumsum(counts)
        through = np.append(0, ends)[np.stack([last - counts, last])]
        return ids, through[1] - through[0]

    return encode
