"""Every operator against brute force, on texts with nulls, empties, copies and odd columns."""

import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from wheeltrace.llm import (
    graph,
    imatch,
    minhash,
    mixing,
    packing,
    pii,
    quality_model,
    quality_rules,
    sharding,
    suffix_dedup,
    url_filter,
)
from wheeltrace.llm.common import tokenizer_path
from wheeltrace.llm.tokens import word_encoder

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
NOISE = "kept boolean, slot bigint, quality string, pii string, node string, size string"


def _rows():
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(300)]
    prose = [
        ". ".join(" ".join(rng.choices(words, k=9)) for _ in range(rng.randint(2, 30)))
        for _ in range(40)
    ]
    near = prose[3].split()
    near[10] = "CHANGED"
    passage = " ".join(rng.choices(words, k=60))
    texts = [
        *prose, None, "", " \n\t", prose[0], prose[0], " ".join(near), prose[3].upper(),
        "one two", "one  two", "x " * 5000, f"{passage} {prose[5]}", f"{prose[6]} {passage}",
        "a\n\nb\na\n a\nb", "é" * 30, "\U0001f600 " * 40,
    ]
    rows = [
        (n * 3, text, "en", None if n == 5 else f"s{n % 3}", 0) for n, text in enumerate(texts)
    ]
    rows.append(rows[7])
    rows.append((None, prose[8], "en", "s0", 0))
    rows.append((None, None, None, None, None))
    return rows


ROWS = _rows()
NAMED = sorted({r[0]: r for r in ROWS if r[0] is not None}.values())


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    for part in NOISE.split(", "):
        name, kind = part.split()
        frame = frame.withColumn(name, F.lit(None).cast(kind))
    return frame


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def _components(links, nodes):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_near_duplicates(spark, docs, empty):
    sets = {r[0]: _shingles(r[1]) for r in NAMED}
    links = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    label = _components(links, sets)
    found = minhash.near_duplicates(docs).collect()
    assert len(found) == len(ROWS)
    for row in found:
        if row.doc_id is None:
            assert row.component_id is None and row.kept
        else:
            assert row.n_shingles == len(sets[row.doc_id])
            assert (row.component_id, row.kept) == (
                label[row.doc_id],
                label[row.doc_id] == row.doc_id,
            )
    assert any(a != b for a, b in label.items())
    assert minhash.near_duplicates(empty).count() == 0


def test_pairs_across_components_finds_links_the_stars_miss(spark):
    """All similar pairs of a common table and different components, each found once."""
    rng = np.random.default_rng(1)
    base = [rng.integers(1, 256, minhash.SKETCH_BINS, dtype=np.uint8) for _ in range(2)]
    own = {n: [int(v) for v in rng.integers(0, 4, 2 * minhash.HALF_KEYS)] for n in range(60)}
    rows = [(n, own[n], bytearray(base[n % 2].tobytes()), 9000) for n in own]
    classes = spark.createDataFrame(
        rows, "node bigint, halves array<bigint>, sketch binary, n_shingles bigint"
    )
    label = {n: 0 if n % 2 == 0 and n < 20 else n for n in own}
    labels = spark.createDataFrame(list(label.items()), "node bigint, component_id bigint")
    members = minhash.bucket_members(classes)
    found = sorted((r.a, r.b) for r in minhash.pairs_across(members, classes, labels).collect())

    def meet(a, b, part):
        return any(x == y for x, y in list(zip(own[a], own[b], strict=True))[part])

    left, right = slice(0, minhash.HALF_KEYS), slice(minhash.HALF_KEYS, None)
    assert found == [
        (a, b)
        for a in own
        for b in own
        if a < b and a % 2 == b % 2 and label[a] != label[b]
        if meet(a, b, left) and meet(a, b, right)
    ]


def test_wanted_texts_pass_the_bitmap(spark):
    docs = spark.range(5000).selectExpr("id * 7 - 900 AS doc_id", "'t' AS text")
    wanted = docs.where("doc_id % 5 = 0").select("doc_id")
    left = {r.doc_id for r in minhash._in_bitmap(docs, wanted).collect()}
    assert left >= {r.doc_id for r in wanted.collect()} and len(left) < 1500
    assert minhash._in_bitmap(docs, wanted.limit(0)).count() == 0


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(n, n + 1) for n in range(40)] + [(rng.randint(60, 99), rng.randint(60, 99)) for _ in range(25)]
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    label = _components(edges, range(100))
    found = {r.node: r.component_id for r in graph.connected_components(frame).collect()}
    assert found == {n: label[n] for a, b in edges if a != b for n in (a, b)}


def _measures(text):
    words = (text or "").encode().split()
    lines, dup = set(), 0
    for line in (text or "").encode().split(b"\n"):
        if line.split():
            dup += line in lines
            lines.add(line)
    windows = {}
    for k in range(len(words) - 7):
        windows.setdefault(tuple(words[k : k + 8]), []).append(k)
    inside = {k + j for ks in windows.values() if len(ks) > 1 for k in ks for j in range(8)}
    chars = sum(len(w.decode()) for w in words)
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(words), chars, symbols, dup, len(inside)


def test_quality_rules(docs, empty):
    found = quality_rules.judged(quality_rules.measured(docs)).collect()
    assert len(found) == len(ROWS)
    for row in found:
        q, expected = row.quality, _measures(row.text)
        assert tuple(q) == expected
        failed = expected[0] < 20 or 100 * expected[4] > 30 * expected[0]
        assert row.base_failed == failed and row.kept == (not failed and not row.host_rejected)
    assert quality_rules.judged(quality_rules.measured(empty)).count() == 0


def test_host_rates_are_shrunk(spark):
    rows = [(n, "x", "bad") for n in range(300)] + [(900, "x", "tiny")]
    rows += [(1000 + n, " ".join(f"word{k}" for k in range(40)), f"h{n % 30}") for n in range(600)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    verdicts = {
        r.source: r.host_rejected
        for r in quality_rules.judged(quality_rules.measured(frame)).collect()
    }
    assert verdicts["bad"] and not verdicts["tiny"] and not any(verdicts[f"h{n}"] for n in range(30))


DISGUISED = [
    ("write to jane.doe (at) mail (dot) example (dot) org now", "email", "jane.doe (at) mail (dot) example (dot) org"),
    ("write to jane at mail dot example dot org now", "email", "jane at mail dot example dot org"),
    ("wrіte jаne@mail.exаmple.com", "email", "jаne@mail.exаmple.com"),
    ("call plus one nine eight eight five five five two four eight five", "phone", "plus one nine eight eight five five five two four eight five"),
    ("ip １０.20.30.4 ok", "ip", "１０.20.30.4"),
    ("ip 10[.]20[.]30[.]4 ok", "ip", "10[.]20[.]30[.]4"),
    ("card 4​041894974608795 ok", "card", "4​041894974608795"),
]


@pytest.mark.parametrize("text,kind,part", DISGUISED)
def test_disguised_identifiers(text, kind, part):
    plain, every = pii.all_spans(text)
    added = [s for s in every if s not in plain]
    assert [(k, text[a:b]) for k, a, b in added] == [(kind, part)]


@pytest.mark.parametrize(
    "text", ["we met at noon at the old mill. dot", "look at home.com", "one, two or three of them", "v 1.2.3.400"]
)
def test_prose_is_left_alone(text):
    assert pii.all_spans(text)[1] == []


def test_pii_on_documents(spark, docs):
    rows = [(1, "a@b.co and 4041894974608795, 10.0.0.255 1.1.1.256 or +1 (988) 555-2485"), (2, None), (3, "")]
    found = pii.find_pii(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert tuple(found[0].pii)[:5] == (1, 1, 1, 1, 0)
    assert found[0].pii.spans.startswith("email:0:6,ip:")
    assert found[1].pii.base_sha256 == found[2].pii.base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = pii.redact(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert clean[0].text == "[EMAIL] and [CARD], [IP] 1.1.1.256 or [PHONE]" and clean[1].text is None
    assert pii.find_pii(docs).count() == len(ROWS)


def test_mix_keeps_every_source_within_a_block(spark, docs, empty):
    rng = random.Random(5)
    rows = [
        (n, "x" * rng.randint(1, 300), rng.choices(["a", "b", "c", "d", None], [60, 20, 12, 6, 2])[0])
        for n in range(4000)
    ]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    mixed = mixing.mix(frame, {"a": 0.4, "b": 0.3, "c": 0.2, "d": 0.1}, block_bytes=2000, round_slots=64)
    found = mixed.collect()
    assert sorted(r.doc_id for r in found) == list(range(4000))
    assert all(r.release <= r.slot < r.due for r in found)
    slots = {(r.source, r.block): r.slot for r in found}
    assert len(set(slots.values())) == len(slots)
    # While no source has run out, each has its weight of every prefix, less than one block off.
    # The null source gets the smallest weight, so 64 slots are dealt 23, 17, 12, 6 and 6.
    for source, share in (("a", 23), ("b", 17), ("c", 12)):
        own = sorted(s for (name, _), s in slots.items() if name == source)
        for n, slot in enumerate(own[:20]):
            assert abs(n - share / 64 * slot) < 1
    assert mixing.mix(docs).count() == len(ROWS)
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed_order(docs).count() == len(ROWS)


def test_pack_round_trip(docs, empty):
    encode = word_encoder(tokenizer_path())
    found = packing.pack(docs, tokenizer_path()).collect()
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    for doc_id, text, *_ in NAMED:
        ids = np.append(encode([text])[0], 1).astype("<u4")
        own = sorted((r.start, r) for r in found if r.doc_id == doc_id)
        assert sum(r.length for _, r in own) == len(ids) * sum(row[0] == doc_id for row in ROWS)
        for start, r in own:
            assert r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[start : start + r.length].tobytes())
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_words_encode_as_whole_texts():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    texts = ["It's  a\ttest, we'll see...", "Σας ΟΔΟΣ", "<|endoftext|>x", "é ́z ½ 3.5", "", "a\x1cb\x1f"]
    ids, counts = word_encoder(tokenizer_path())(texts)
    each = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(e) for e in each] and ids.tolist() == sum(each, [])


def test_cuts_are_the_cheapest():
    rng = random.Random(11)
    for _ in range(30):
        cuts = np.cumsum([0] + [rng.randint(1, 700) for _ in range(25)])
        costs = np.array([rng.choice([0, 2]) for _ in cuts])
        best = [0] + [10**9] * 25
        for j in range(1, 26):
            for i in range(j):
                size = int(cuts[j] - cuts[i])
                if size <= 2048:
                    pad = min([2048 - size] + [packing.SHORT_PENALTY] * (size in packing.FREE_LENGTHS))
                    best[j] = min(best[j], best[i] + pad + int(costs[j]))
        ends = packing.choose_cuts(cuts, costs)
        total, at = 0, 0
        for end in ends:
            size = end - at
            pad = min([2048 - size] + [packing.SHORT_PENALTY] * (size in packing.FREE_LENGTHS))
            total, at = total + pad + int(costs[list(cuts).index(end)]), end
        assert at == cuts[-1] and total == best[-1]


def test_url_parts_and_false_positives(spark):
    urls = ["http://A.Example.ORG:80/es/x?q#f", "x", None, "http://", "ftp://e.com?x://y", "http://ss.example.com/de/1", "https://www.bad.net/a.html", "http://bad.net/a/", "http://good.net/a"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    pages = pages.withColumn("rule", F.lit("old"))
    listed = spark.createDataFrame([("bad.net/a",), (None,), ("bad.net/a",)], "canonical string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, listed).collect()}
    assert found[0] == ("a.example.org:80", "/es/x", None, "allow")
    assert found[1] == found[2] == found[3] == ("", "", None, "allow")
    assert found[4] == ("e.com", "", None, "allow")
    assert found[5][2:] == ("com/de/", "block")
    assert [found[n][3] for n in (6, 7, 8)] == ["block", "block", "allow"]
    assert url_filter.judge_urls(pages.limit(0), listed.limit(0)).count() == 0


def test_suffix_dedup(docs, empty):
    seen, expected = {}, {}
    for doc_id, text, *_ in NAMED:
        data = (text or "").encode()
        gone = bytearray(len(data))
        strings = [data[k : k + 50] for k in range(len(data) - 49)]
        for k, string in enumerate(strings):
            if string in seen:
                gone[k : k + 50] = b"\1" * 50
        seen |= dict.fromkeys(strings)
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(data)))
        expected[doc_id] = (len(data), sum(gone), spans, kept)
    found = suffix_dedup.cut_repeats(docs).collect()
    assert len(found) == len(ROWS)
    for r in found:
        if r.doc_id is not None:
            assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == expected[r.doc_id]
        else:
            assert r.n_removed == r.n_bytes
    assert suffix_dedup.cut_repeats(empty).count() == 0


@pytest.mark.parametrize("range_bytes", [32 << 20, 3000])
def test_imatch(spark, docs, empty, range_bytes):
    """The report against plain Python, in one range and in many."""
    report = imatch.edit_report(docs, range_bytes).collect()
    assert len(report) == len(ROWS)
    terms = imatch.lexicon(docs)

    def prints(texts):
        return imatch._text(imatch._fingerprints(texts, terms))

    for r in report:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    found = {r.doc_id: r for r in report}
    # Repeated and missing ids have several rows; their neighbours are tested by the others.
    ordered = list(reversed(NAMED))
    unique = {r[0] for r in NAMED} - {ROWS[7][0], NAMED[0][0]}
    for row, after in zip(ordered, ordered[1:], strict=False):
        if row[0] not in unique:
            continue
        text, following = row[1] or "", after[1] or ""
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        own, changed, near = prints([text, edited, following])
        r = found[row[0]]
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint) == (len(text), own, changed)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == imatch.likeness([own], [changed])[0]
        assert r.near_next == imatch.likeness([own], [near])[0]
    assert imatch.edit_report(empty).count() == 0
    alone = imatch.edit_report(spark.createDataFrame([(1, "a b c d", "", "", 0)], SCHEMA)).first()
    assert alone.edited_sha256 == hashlib.sha256(b"a b " + b"a b").hexdigest()


def test_shards(docs, empty):
    found = sharding.shard(docs, shards=4).collect()
    assert len(found) == len(ROWS)
    weights = [0] * 4
    for r in found:
        assert r["size"] == len((r.text or "").encode()) + 8
        weights[r.shard] += r["size"]
    for shard in range(4):
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert max(weights) - min(weights) <= 2 * max(r["size"] for r in found)
    assert sharding.shard(empty).count() == 0


def test_shards_split_a_heavy_text(spark):
    rows = [(n, "same text " * 20) for n in range(500)] + [(n, f"other {n}") for n in range(500, 900)]
    found = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string"), shards=6).collect()
    weights = [sum(r["size"] for r in found if r.shard == k) for k in range(6)]
    assert max(weights) - min(weights) <= 450


def test_classifier_learns_an_interaction(spark):
    rng = np.random.default_rng(2)
    x, y, z = rng.random((3, 4000))
    label = ((x > 0.5) ^ (y > 0.5)).astype(float)
    rows = [(n, *map(float, v)) for n, v in enumerate(zip(x, y, z, label, strict=True))]
    frame = spark.createDataFrame(rows, "id bigint, x double, y double, z double, label double")
    model = quality_model.fit(frame.where("id % 5 != 0"), ["x", "y", "z"], "label", "id")
    scored = frame.where("id % 5 = 0").withColumn("s", quality_model.scorer(model)(["x", "y", "z"]))
    assert np.mean([(r.s > 0.5) == (r.label > 0.5) for r in scored.collect()]) > 0.95


def test_classifier_on_documents(spark, docs, empty):
    labels = spark.createDataFrame(
        [(n * 3, None if n == 4 else n % 2, 0) for n in range(30)] + [(0, 1, 0)],
        "doc_id bigint, quality int, toxic int",
    )
    found = quality_model.score_quality(docs, labels).collect()
    assert len(found) == len(ROWS)
    for r in found:
        held = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        assert r.held_out == held and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    assert quality_model.score_quality(docs, labels.limit(0)).count() == len(ROWS)
    assert quality_model.score_quality(empty, labels).count() == 0


def _windows(weights, blocks):
    """(release, due) of every source's blocks by exact fractions, those of the whole schedule."""
    def reached(v):
        return sum(min(w * v, n) for w, n in zip(weights, blocks, strict=True))

    return [
        [(math.floor(reached(i / w)), math.ceil(reached((i + 1) / w))) for i in range(n)]
        for w, n in zip(weights, blocks, strict=True)
    ]


@pytest.mark.parametrize(
    "weights,blocks",
    [
        # Of 256 slots 12.41, 230.2 and 0.1 are due; then the others run out.
        ([Fraction(1241), Fraction(23020), Fraction(10), Fraction(1329)], [150, 2600, 3, 170]),
        # More than 256 sources, of two weights.
        ([Fraction(1 + 2 * (n % 2)) for n in range(300)], [2 + 4 * (n % 2) for n in range(300)]),
    ],
)
def test_plan_keeps_the_targets_over_many_rounds(spark, weights, blocks):
    names = [f"s{n:03}" for n in range(len(weights))]
    totals = spark.createDataFrame(list(zip(names, blocks, strict=True)), "source string, blocks bigint")
    given = {name: float(w) for name, w in zip(names, weights, strict=True)}
    found = mixing.slot_plan(mixing.target_weights(totals, given)).collect()
    assert sorted(r.slot for r in found) == list(range(sum(blocks)))
    windows = _windows(weights, blocks)
    before_end = min(n / w for w, n in zip(weights, blocks, strict=True)) * sum(weights)
    for k, name in enumerate(names):
        own = sorted((r.slot, r.block, r.release, r.due) for r in found if r.source == name)
        assert [r[1] for r in own] == list(range(blocks[k]))
        for slot, i, release, due in own:
            assert release <= slot < due
            # A weight that is not a whole number in 64 bits may move an edge that is one.
            assert abs(release - windows[k][i][0]) <= 1 and abs(due - windows[k][i][1]) <= 1
            if slot < before_end:
                target = weights[k] / sum(weights)
                assert abs(i - target * slot) < 1 + 1e-9 and abs(i + 1 - target * (slot + 1)) < 1 + 1e-9
