"""Host verdicts and personal data against plain Python."""

import random
import re
import time
from collections import defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from wheeltrace.llm import pii, quality_rules

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
GOOD = " ".join(f"plain{n}" for n in range(40))
BAD = GOOD + "".join(" " + "#" * n for n in range(1, 9))


def _host_rows():
    """A host of mostly bad documents, one like it but small, and honest ones."""
    rows = [("bad", n % 10 < 8) for n in range(120)] + [("tiny", True)]
    rows += [(f"host{n % 30}", n % 40 == 0) for n in range(1200)] + [(None, True)] * 5
    return [(n, BAD if bad else GOOD, "en", host, 0) for n, (host, bad) in enumerate(rows)]


def test_prior_and_verdicts_that_fire(spark):
    rows = _host_rows()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("host_rate", F.lit("x"))
    found = quality_rules.judged(quality_rules.measured(docs)).collect()
    counts = defaultdict(lambda: [0, 0])
    for _, text, _, host, _ in rows:
        if host is not None:
            counts[host][0] += 1
            counts[host][1] += text == BAD
    total, failed = (sum(c[k] for c in counts.values()) for k in (0, 1))
    mean = failed / total
    raw = [f / n for n, f in counts.values()]
    middle = sum(raw) / len(raw)
    noise = mean * (1 - mean) * sum(1 / n for n, _ in counts.values()) / len(counts)
    var = sum((r - middle) ** 2 for r in raw) / len(raw) - noise
    strength = max(mean * (1 - mean) / var - 1 if var > 0 else 0, quality_rules.MIN_STRENGTH)
    for row in found:
        if row.source is None:
            assert row.kept and not row.host_rejected
            continue
        n, f = counts[row.source]
        rate = (f + mean * strength) / (n + strength)
        assert row.host_rate == pytest.approx(rate, rel=1e-9)
        assert row.host_rejected == (rate > quality_rules.MAX_HOST_RATE) == (row.source == "bad")
        assert row.kept == (not row.host_rejected)


def test_stage_keeps_columns_that_clash(spark):
    docs = spark.createDataFrame(_host_rows(), SCHEMA).withColumns(
        {"quality": F.lit(0.5), "host_rate": F.lit("x"), "kept": F.lit(3), "_in1": F.lit("y")}
    )
    kept = corpus_pipeline.keep_good(spark, docs, "")
    assert kept.schema == docs.schema
    expected = docs.where("source IS NULL OR source != 'bad'")
    assert kept.exceptAll(expected).count() == 0 and expected.exceptAll(kept).count() == 0


# The base patterns as they are defined.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(text):
    digits = [int(c) for c in reversed(re.sub("[^0-9]", "", text))]
    odd = sum(digits[::2])
    return (odd + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


def _plain_spans(text):
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(part) > 255 for part in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and _luhn(m[0])):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            yield kind, m.start(), m.end()


def test_base_spans_by_brute_force():
    rng = random.Random(4)
    pieces = ["a", "b1", "@", ".", "_", "-", " ", "+4", "1", "255", "256", "007", "x@y.z", "@@",
              "4111 1111 1111 1111", "é", "1.2.3.4", "(0)", "%", "+1 (555) 123-4567"]
    for _ in range(4000):
        text = "".join(rng.choices(pieces, k=rng.randint(1, 14)))
        assert pii.find_spans(text) == list(_plain_spans(text)), text


DISGUISED = [
    ("write to ann.lee [at] mail [dot] example [dot] org now", "email", "ann.lee", "org"),
    ("ann(at)example.org", "email", "ann", "org"),
    ("ann at example dot org", "email", "ann", "org"),
    ("user\nat gmail dot com", "email", "user", "com"),
    ("ann dot lee at example dot co dot uk", "email", "ann", "uk"),
    ("аnn@exаmple.org", "email", "аnn", "org"),
    ("ann＠example．org", "email", "ann", "org"),
    ("an​n@exam​ple.org", "email", "an", "org"),
    ("ann <at> example.org", "email", "ann", "org"),
    ("host 192 [.] 168 [.] 0 [.] 1 up", "ip", "192", "1"),
    ("host 10 dot 0 dot 0 dot 17", "ip", "10", "17"),
    ("call plus four nine one five one two three four five six seven", "phone", "plus", "seven"),
    ("card ４１１１ 1111 1111 1111", "card", "４", "1111"),
]
PROSE = [
    "We left at home.com prices.", "Look at this. Dot com is over.", "at at at dot dot dot",
    "version 1.2.3 at 4.5", "one two buckle my shoe", "a+b at c", "(at) the end (dot)",
]


def test_disguises_are_found_and_prose_is_left_alone():
    caught = 0
    for text, kind, begins, ends in DISGUISED:
        plain, every = pii.all_spans(text)
        found = [text[s:e] for k, s, e in every if k == kind]
        caught += any(f.startswith(begins) and f.endswith(ends) for f in found)
    assert caught / len(DISGUISED) >= 0.9
    assert [text for text in PROSE if pii.all_spans(text)[1]] == []


@pytest.mark.parametrize(
    "text",
    ["a" * 1_000_000 + " x@", "7" * 1_000_000 + " @ .", " " * 1_000_000 + "[at] [dot]",
     "a@" * 300_000 + " at dot ", "1." * 500_000, "x dot " * 200_000 + " at y", "one " * 250_000,
     "+1 " + " " * 1_000_000, "a@b.c " * 100_000 + "[at]", "at " * 300_000 + " dot "],
)
def test_long_texts_take_linear_time(text):
    started = time.process_time()
    pii.all_spans(text)
    assert time.process_time() - started < 8
