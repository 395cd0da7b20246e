"""op8: every term of the band counts, and texts without one are told apart."""

import numpy as np
import pandas as pd

from wheeltrace.llm import imatch
from wheeltrace.llm.common import mix

WORDS = [f"word{n}" for n in range(600)]
BAND = np.sort(imatch.term_hashes([" ".join(WORDS)])[0])


def _prints(texts):
    return imatch._text(imatch._fingerprints(texts, BAND))


def _like(a, b):
    return imatch.likeness([a], [b])[0]


def test_fingerprints_by_brute_force():
    texts = [" ".join(WORDS[n::17] + ["outside"] * n) for n in range(17)] + ["only here", "!?", None, " "]
    for text, found in zip(texts, _prints(texts), strict=True):
        words = set((text or "").split())
        chosen = (words & set(WORDS)) or words
        sums = [0] * imatch.LEXICONS
        for h in pd.util.hash_array(np.array([w.encode() for w in sorted(chosen)], object), categorize=False):
            lexicon = int(mix(np.array([h + np.uint64(1)]))[0] >> np.uint64(32)) % imatch.LEXICONS
            sums[lexicon] = (sums[lexicon] + int(mix(np.array([h + np.uint64(2)]))[0])) % 2**64
        assert found == "".join(f"{(v >> 48) or int(v > 0):04x}" for v in sums)


def test_every_term_of_the_band_changes_the_fingerprint():
    whole = _prints([" ".join(WORDS)])[0]
    for word, lacking in zip(
        WORDS, _prints([" ".join(w for w in WORDS if w != word) for word in WORDS]), strict=True
    ):
        assert lacking != whole, word
    assert "0" * len(whole) not in _prints(WORDS)


def test_texts_without_terms_of_the_band_are_told_apart():
    one, other, same, signs, more, none, blank = _prints(
        ["quite alone here", "nothing shared", "here quite ALONE", "!!", "?-", None, " \n"]
    )
    assert _like(one, other) == 0 and _like(one, same) == 1 and _like(signs, more) == 0
    assert _like(none, blank) == 1 and set(none) == set(blank) == {"0"}
    assert imatch._text(imatch._fingerprints(["a b", "c"], BAND[:0])) != _prints([None, None])
