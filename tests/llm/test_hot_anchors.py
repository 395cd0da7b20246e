"""op7 where many texts hold one anchor: equal surroundings, different ones, periodic texts."""

import random
import time

import numpy as np
import pandas as pd
import pytest

from wheeltrace.llm import suffix_dedup


def _expected(texts):
    seen, found = set(), {}
    for doc_id, text in sorted(texts):
        data = text.encode()
        gone = bytearray(len(data))
        strings = [data[k : k + 50] for k in range(len(data) - 49)]
        for k, string in enumerate(strings):
            if string in seen:
                gone[k : k + 50] = b"\1" * 50
        seen.update(strings)
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        found[doc_id] = (len(data), sum(gone), kept)
    return found


def _texts():
    rng = random.Random(11)

    def prose(n):
        return "".join(rng.choices("abcdefghijklmnop ", k=n))

    passage = prose(130)
    for n in range(60):
        kind = n % 4
        if kind == 0:
            text = prose(rng.randint(0, 60)) + passage + prose(rng.randint(0, 60))
        elif kind == 1:
            text = "of the " * rng.randint(5, 40) + prose(rng.randint(0, 3))
        elif kind == 2:
            text = prose(30) + passage[: rng.randint(40, 130)] + "of the " * 12
        else:
            text = prose(rng.randint(0, 120)) + "\0" * rng.randint(0, 70)
        yield n * 7 % 61, text


@pytest.mark.parametrize("many", [2, 4, 20])
def test_shared_anchors(monkeypatch, many):
    """Grams of several classes, with those of many, in batches that cut through them."""
    monkeypatch.setattr(suffix_dedup, "MANY_TEXTS", many)
    rows = [(1, 1), (2, 1), (2, 2), (3, 5), (3, 5), (4, 1), (4, 2), (4, 2), (4, 3), (4, 4)]
    rows += [(4, k) for k in range(5, 12)] + [(5, 2), (5, 2), (6, 1), (6, 9), (6, 9)]
    frame = pd.DataFrame(rows, columns=["gram", "class"])
    classes = frame.drop_duplicates().groupby("gram").size()
    expected = {(g, c, bool(classes[g] > many)) for g, c in rows if classes[g] > 1}
    for size in range(1, len(rows) + 1):
        parts = suffix_dedup._shared_anchors(frame[k : k + size] for k in range(0, len(rows), size))
        found = [tuple(row) for part in parts for row in part.itertuples(index=False)]
        assert len(found) == len(set(found)) and set(found) == expected
    assert not list(suffix_dedup._shared_anchors(iter(())))


def test_hot_anchors(spark):
    """More texts with one anchor than MANY_TEXTS, few of them alike."""
    texts = list(_texts())
    top = len(texts)
    rng = random.Random(3)
    line = "a line that a great many of the pages have in common"
    texts += [
        (top + 1 + k, f"{rng.randint(0, 9)}{line}{rng.randint(0, 400)}")
        for k in range(suffix_dedup.MANY_TEXTS + 900)
    ]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    found = suffix_dedup.cut_repeats(frame).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, bytes(r.kept)) for r in found} == _expected(texts)


@pytest.mark.parametrize("stretch", [20, 40_000])
@pytest.mark.parametrize("remembered", [0, 3, 20_000])
@pytest.mark.parametrize("hot", [False, True])
def test_short_stretches_and_memory(monkeypatch, stretch, remembered, hot):
    """The two steps as a task runs them, with bounds that these few rows exceed."""
    texts = list(_texts())
    monkeypatch.setattr(suffix_dedup, "STRETCH", stretch)
    monkeypatch.setattr(suffix_dedup, "REMEMBERED", remembered)
    rows = []
    for doc_id, text in sorted(texts):
        grams = suffix_dedup._grams([text])[0].view("int64")
        rows.append((doc_id, text, doc_id, grams, grams[grams % 2 == 0] if hot else grams[:0]))
    frame = pd.DataFrame(rows, columns=["doc", "text", "class", "grams", "hot"])
    # Two tasks, each with batches of seven texts.
    parts = []
    for task in (frame[::2], frame[1::2]):
        parts += suffix_dedup._contexts(task[k : k + 7] for k in range(0, len(task), 7))
    sent = pd.concat(parts).sort_values(["key", "doc"]).reset_index(drop=True)
    found = pd.concat(suffix_dedup._covered(sent[k : k + 9] for k in range(0, len(sent), 9)))
    starts = {
        (doc, first + bit)
        for doc, first, bits in zip(found["doc"], found["first"], found["covered"], strict=True)
        for bit in range(suffix_dedup.REACH)
        if bits >> bit & 1
    }
    seen, expected = set(), set()
    for doc_id, text in sorted(texts):
        data = text.encode()
        strings = [data[k : k + 50] for k in range(len(data) - 49)]
        expected |= {(doc_id, k) for k, string in enumerate(strings) if string in seen}
        seen.update(strings)
    assert starts == expected


def test_names_are_ranks_of_tuples():
    """Also where the parts of a tuple do not fit into one number."""
    draw = np.random.default_rng(2)
    wide = draw.integers(0, 1 << 64, 50, dtype=np.uint64)[draw.integers(0, 50, 3000)]
    small = draw.integers(0, 3, 3000)
    middle = draw.integers(0, 1 << 30, 40)[draw.integers(0, 40, 3000)]
    for keys in ((small,), (wide, small), (middle, middle[::-1], middle, small), (wide,) * 4):
        tuples = list(zip(*(key.tolist() for key in keys)))
        ranks = {own: rank for rank, own in enumerate(sorted(set(tuples)))}
        assert suffix_dedup._names(*keys).tolist() == [ranks[own] for own in tuples]
        # One number is sorted at a time, which numpy does several times faster.
        assert "lexsort" not in suffix_dedup._names.__code__.co_names
    assert suffix_dedup._names(wide[:0], small[:0]).tolist() == []


def test_settled_starts_travel_as_one_row_of_a_text():
    """Repeats that a task has met before: one row of each text, with all of their starts."""
    passage = "".join(random.Random(4).choices("abcdefghijklmnop ", k=300))
    grams = suffix_dedup._grams([passage])[0].view("int64")
    rows = [(doc, passage, doc * 10, grams, grams[:0]) for doc in (1, 2, 3)]
    frame = pd.DataFrame(rows, columns=["doc", "text", "class", "grams", "hot"])
    sent = pd.concat(suffix_dedup._contexts(iter([frame])))
    settled = sent[sent["covered"] == suffix_dedup.PACKED]
    assert sorted(settled["doc"]) == [2, 3] and len(grams) > 5
    found = suffix_dedup._unpacked(settled)
    for doc in (2, 3):
        own = found[found["doc"] == doc]
        starts = {
            first + bit
            for first, bits in zip(own["first"], own["covered"], strict=True)
            for bit in range(suffix_dedup.REACH)
            if bits >> bit & 1
        }
        assert starts == set(range(len(passage) - 49)) and set(own["class"]) == {doc * 10}


def test_steps_leave_no_shuffle_files(spark):
    """Shuffles of written steps are off the disk before the next step, not at some collection."""

    def shuffles():
        blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager()
        names = blocks.diskBlockManager().getAllFiles()
        return {n for n in (names.apply(k).getName() for k in range(names.size())) if "shuffle" in n}

    frame = spark.createDataFrame(list(_texts()), "doc_id bigint, text string").repartition(3)
    before = shuffles()
    found = suffix_dedup.cut_repeats(frame)
    until = time.time() + 20
    # Files go in the background, right after the write.
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before
    assert found.count() == 60
