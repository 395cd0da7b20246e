"""Personal data in texts, also where it is disguised.

Plain identifiers are found in the source text. Then a transducer rewrites the text: homoglyphs
and full-width characters become ASCII, spelled digits become digits, "(at)", " dot " and the
like become "@" and ".", invisible characters vanish. It keeps the source offsets of each
character it writes. Identifiers of the rewritten text are mapped back to the source by those
offsets, and those that lie in no plain one are added.
"""

from __future__ import annotations

import hashlib
import re
import string
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

KINDS = ("email", "ip", "card", "phone")

# Patterns are written so that no long run of characters is tried from each of its places.
_LOCAL = "[A-Za-z0-9._%+-]"
_LOCAL_CHARACTERS = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

# Characters that look like the ASCII character below them.
_LOOKALIKES = "АВЕКМНОРСТХаеорсухіјѕԁɡΑΒΕΖΗΙΚΜΝΟΡΤΥΧαιονρ＠﹫．。․＋‐‑‒–—−"
_LOOKS_LIKE = "ABEKMHOPCTXaeopcyxijsdgABEZHIKMNOPTYXaiovp@@...+------"
_PLAIN = dict(zip(map(ord, _LOOKALIKES), _LOOKS_LIKE, strict=True))
_PLAIN |= {0xFF10 + d: str(d) for d in range(10)}
_PLAIN |= {0xFF21 + k: chr(65 + k) for k in range(26)} | {0xFF41 + k: chr(97 + k) for k in range(26)}
_PLAIN |= {0x00A0: " ", 0x2007: " ", 0x202F: " "}
# Zero-width and soft-hyphen characters, written inside identifiers to break patterns.
_INVISIBLE = "­​‌‍⁠﻿"

_DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4",
    "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
}
_WORD = "(?:" + "|".join(_DIGIT_WORDS) + ")"
# A spelled digit counts in a run of three or more digits or spelled digits.
_DIGIT = f"(?:[0-9]|{_WORD}(?![A-Za-z]))"
_SPELLED_RUN = re.compile(
    rf"(?<![A-Za-z])(?:plus[ ]{{0,4}}(?={_DIGIT}))?(?:{_DIGIT}[ ().+-]{{0,3}}(?:(?:dot|point)[ ]{{1,4}})?)"
    rf"{{2,}}{_DIGIT}",
    re.IGNORECASE,
)
_SPELLED = re.compile(
    rf"plus[ ]{{0,4}}|[ ]{{0,4}}(?<![A-Za-z])(?:dot|point)(?![A-Za-z])[ ]{{0,4}}"
    rf"|{_WORD}(?![A-Za-z])(?:[ -](?={_DIGIT}))?",
    re.IGNORECASE,
)
# White space inside a disguise, line breaks included; bounded, so that long gaps cost nothing.
_GAP = "[ \\t\\r\\n]{1,4}"
_MAY = "[ \\t\\r\\n]{0,4}"
_AT = rf"{_MAY}[\[({{<]{_MAY}(?:at|@){_MAY}[\])}}>]{_MAY}|{_GAP}at{_GAP}|{_GAP}@{_MAY}|@{_GAP}"
_DOT = rf"{_MAY}[\[({{<]{_MAY}(?:dot|\.){_MAY}[\])}}>]{_MAY}|{_GAP}dot{_GAP}"
_DOT_BACKWARDS = rf"{_MAY}[\])}}>]{_MAY}(?:tod|\.){_MAY}[\[({{<]{_MAY}|{_GAP}tod{_GAP}"
# An address in disguise needs both a written "at" and a dot of some form after it, and one of
# the two disguised, so that prose with the word "at" is left alone. It is looked for from its
# "at" to both sides, to the left in the reversed text.
_ANY_AT = re.compile(rf"{_AT}|@", re.IGNORECASE)
_RIGHT_OF_AT = re.compile(
    rf"[A-Za-z0-9-]++(?:(?:{_DOT}|\.)[A-Za-z0-9-]++)+", re.IGNORECASE
)
_LEFT_OF_AT = re.compile(rf"{_LOCAL}++(?:(?:{_DOT_BACKWARDS}){_LOCAL}++)*", re.IGNORECASE)
_ADDRESS_PART = re.compile(rf"(?P<at>{_AT})|(?P<dot>{_DOT})", re.IGNORECASE)
_SPLIT_IP = re.compile(
    rf"[0-9]{{1,3}}(?:(?:{_DOT}|\.)[0-9]{{1,3}}){{3}}",
    re.IGNORECASE,
)
_AT_HINT = re.compile(rf"@|[\[({{<]{_MAY}at{_MAY}[\])}}>]", re.IGNORECASE)
_DOT_HINT = re.compile(rf"[\[({{<]{_MAY}(?:dot|\.){_MAY}[\])}}>]|\sdot\s", re.IGNORECASE)
_SPELLED_HINT = re.compile(rf"(?<![A-Za-z]){_WORD}(?![A-Za-z])", re.IGNORECASE)


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses that do not overlap, found from their "@" to both sides."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARACTERS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """Plain identifiers as (kind, start, end), kind by kind, from left to right."""
    found = []
    if "@" in text:
        found += [("email", *span) for span in _emails(text)]
    for m in _IP.finditer(text):
        # Longer numbers exceed 255 without being read, leading zeros aside.
        if all(len(part.lstrip("0")) <= 3 and int(part[-9:]) <= 255 for part in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append(("phone", *m.span()))
    return found


class _Tape:
    """A text being rewritten, with the source range of each of its characters."""

    def __init__(self, text: str):
        self.text = text
        self.starts = range(len(text))
        self.ends = range(1, len(text) + 1)

    def rewrite(self, changes: Iterator[tuple[int, int, str]]) -> None:
        """Replace ranges, in order, each by at most one character or by nothing."""
        text, starts, ends, at = [], [], [], 0
        for start, end, new in changes:
            text += [self.text[at:start], new]
            starts += self.starts[at:start]
            ends += self.ends[at:start]
            if new:
                starts.append(self.starts[start])
                ends.append(self.ends[end - 1])
            at = end
        if at:
            text.append(self.text[at:])
            starts += self.starts[at:]
            ends += self.ends[at:]
            self.text, self.starts, self.ends = "".join(text), starts, ends


def _spelled_digits(text: str) -> Iterator[tuple[int, int, str]]:
    for run in _SPELLED_RUN.finditer(text):
        for m in _SPELLED.finditer(text, *run.span()):
            word = m[0].strip(" -").lower()
            new = "+" if word == "plus" else "." if word in ("dot", "point") else None
            yield (*m.span(), new or _DIGIT_WORDS[word])


def _disguised_addresses(text: str) -> Iterator[tuple[int, int]]:
    done, backwards, n = 0, text[::-1], len(text)
    for at in _ANY_AT.finditer(text):
        if at.start() < done:
            continue
        left = _LEFT_OF_AT.match(backwards, n - at.start(), n - done)
        right = _RIGHT_OF_AT.match(text, at.end()) if left else None
        if right:
            yield n - left.end(), right.end()
            done = right.end()


def _split_addresses(text: str) -> Iterator[tuple[int, int, str]]:
    for span in _disguised_addresses(text):
        parts = list(_ADDRESS_PART.finditer(text, *span))
        loose_at = any(m["at"] and m["at"].strip().lower() in ("at", "@") for m in parts)
        # Bare " at " or spaced "@" needs a written dot too: "left at home.com" is prose.
        if loose_at and not any(m["dot"] for m in parts):
            continue
        cuts = [span[0], *[edge for m in parts for edge in m.span()], span[1]]
        names = [text[a:b].lower() for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
        if loose_at and not {"at", "dot"}.isdisjoint(names):
            continue
        for m in parts:
            yield (*m.span(), "@" if m["at"] else ".")


def _split_ips(text: str) -> Iterator[tuple[int, int, str]]:
    for address in _SPLIT_IP.finditer(text):
        for m in _ADDRESS_PART.finditer(text, *address.span()):
            if m["dot"]:
                yield (*m.span(), ".")


def deobfuscated(text: str) -> _Tape | None:
    """The rewritten text, or None if nothing was disguised."""
    tape = _Tape(text)
    if not text.isascii():
        # One character for one: offsets stay. Letters of accented prose are not touched.
        tape.text = text.translate(_PLAIN)
        if any(c in text for c in _INVISIBLE):
            broken = re.finditer(f"[{_INVISIBLE}]+", tape.text)
            tape.rewrite((*m.span(), "") for m in broken)
    if _SPELLED_HINT.search(tape.text):
        tape.rewrite(_spelled_digits(tape.text))
    has_dot = _DOT_HINT.search(tape.text)
    if has_dot or _AT_HINT.search(tape.text):
        tape.rewrite(_split_addresses(tape.text))
    if has_dot:
        tape.rewrite(_split_ips(tape.text))
    return None if tape.text == text else tape


def all_spans(text: str) -> tuple[list, list]:
    """Plain spans, and plain and disguised spans together, by kind and start."""
    plain = find_spans(text)
    tape = deobfuscated(text)
    if tape is None:
        return plain, plain
    found = list(plain)
    ordered = sorted((start, end) for _, start, end in plain)
    starts = [start for start, _ in ordered]
    reach = list(accumulate((end for _, end in ordered), max))
    for kind, start, end in find_spans(tape.text):
        span = tape.starts[start], tape.ends[end - 1]
        # The plain spans that begin no later; does one of them reach as far?
        before = bisect_right(starts, span[0])
        if not before or reach[before - 1] < span[1]:
            found.append((kind, *span))
    return plain, sorted(found, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def redacted_text(text: str) -> str:
    """The text with each stretch of personal data replaced by the kind of its first span."""
    merged: list[list] = []
    for kind, start, end in sorted(all_spans(text)[1], key=lambda s: (s[1], -s[2])):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    pieces, at = [], 0
    for kind, start, end in merged:
        pieces += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(pieces) + text[at:] if merged else text


_COUNTS = [f"n_{kind}" for kind in KINDS] + ["n_disguised"]
_REPORT = T.StructType(
    [T.StructField(name, T.LongType()) for name in _COUNTS]
    + [T.StructField(name, T.StringType()) for name in ("base_sha256", "spans")]
)


@pandas_udf(_REPORT)
def _report(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        plain, every = all_spans(text if isinstance(text, str) else "")
        kinds = [kind for kind, _, _ in plain]
        rows.append(
            (
                *[kinds.count(kind) for kind in KINDS],
                len(every) - len(plain),
                hashlib.sha256(joined(plain).encode()).hexdigest(),
                joined(every),
            )
        )
    return pd.DataFrame(rows, columns=_REPORT.names)


@pandas_udf(T.StringType())
def _redacted(texts: pd.Series) -> pd.Series:
    return texts.map(redacted_text, na_action="ignore")


def find_pii(docs: DataFrame) -> DataFrame:
    """All columns of `docs` and `pii`, a struct of counts and spans; no shuffle.

    n_email, n_ip, n_card and n_phone count plain identifiers, n_disguised those that only the
    rewritten text shows. `spans` lists both as kind:start:end in code points of the source.
    A null or empty text has none. Repeated rows get equal results, an empty table stays empty,
    an input column `pii` is replaced.
    """
    return docs.withColumn("pii", _report("text"))


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with personal data in `text` replaced by [EMAIL], [IP], [CARD] or [PHONE].

    `n_chars` is set anew if there is such a column. Null texts stay null.
    """
    clean = docs.withColumn("text", _redacted("text"))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.char_length("text").cast("bigint"))
    return clean
