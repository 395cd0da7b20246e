"""Filter audit, prefix trie and exact dedup against brute force, odd input included."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from wheeltrace.llm import exact_dedup, filter_audit, prefix_trie

BIG = (1 << 53) + 1
SPACE = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _texts():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeXYZé", k=rng.randint(1, 6))) for _ in range(500)]
    plain = [" ".join(rng.choices(words, k=rng.choice([3, 150, 250]))) for _ in range(30)]
    plain += [" ".join(rng.choices(words[:40], k=260)).lower() for _ in range(5)]
    same_head = "h" * 80
    return [
        *plain, None, "", " \n\t", plain[0], plain[1].replace(" ", "\n\t"), plain[1] + " \x0b",
        "a b", "ab", "a b", same_head + "1", same_head + "2", same_head + " 1",
        plain[2] + " #", "\U0001f600 " * 300, "w " * 60_000, "w" * 60_000,
    ]


def _doc_rows():
    rows = [
        (BIG + n, text, "en", [None, "", "s1", "s2"][n % 4], 0) for n, text in enumerate(_texts())
    ]
    rows += [rows[3], (None, rows[4][1], "en", "s1", 0), (None, None, None, None, None)]
    rows += [(None, "only here", "en", "s1", 0), (None, "only here", "en", "s1", 0)]
    # A group of copies with a third of all rows.
    rows += [(5000 + n, "copied text of a hot group", "en", "s2", 0) for n in range(30)]
    return rows


ROWS = _doc_rows()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ["part", "kept", "prefix", "bit", "_row", "_size", "A", "keep_id", "text_sha256", "_hash"]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    return frame.withColumns({name: F.lit("x") for name in CLASH})


def _bare(text):
    return SPACE.sub("", text or "")


def _expected_exact():
    groups = defaultdict(list)
    for doc_id, text, *_ in ROWS:
        groups[_bare(text)].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    found = Counter()
    for bare, members in groups.items():
        members.sort(key=lambda m: m[:3])
        digest = hashlib.sha256(bare.encode()).hexdigest()
        for place, member in enumerate(members):
            found[(member[3], members[0][3], len(members), place == 0, digest)] += 1
    return found


@pytest.mark.parametrize("broadcast_keys", [exact_dedup.BROADCAST_KEYS, 2])
def test_exact_duplicates(docs, monkeypatch, broadcast_keys):
    monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", broadcast_keys)
    rows = exact_dedup.exact_duplicates(docs, all_hashes=True).collect()
    assert Counter(tuple(row) for row in rows) == _expected_exact()
    # Without the digests of settled texts the groups are the same.
    bare = exact_dedup.exact_duplicates(docs).drop("text_sha256").collect()
    assert Counter(map(tuple, bare)) == Counter(tuple(row)[:4] for row in rows)


def test_texts_settled_by_length_or_prefix_are_not_hashed(spark, docs):
    rows = exact_dedup.exact_duplicates(docs).collect()
    bares = Counter((len(_bare(r[1])), _bare(r[1])[: exact_dedup.PREFIX_CHARS]) for r in ROWS)
    shared = sum(n for n in bares.values() if n > 1)
    hashed = [row for row in rows if row.text_sha256 is not None]
    assert len(hashed) == shared < len(rows)


def _fails(rows):
    first = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    for doc_id, text, _, source, _ in rows:
        text = text or ""
        words = WORD.findall(text)
        least = first.get(text)
        yield doc_id, source or "", {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": least is not None and (doc_id is None or least < doc_id),
        }


def test_audit(spark, docs):
    rng = random.Random(1)
    ids = [row[0] for row in ROWS if row[0] is not None]
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in rng.sample(ids, 50)]
    labels += [labels[0], (labels[1][0], 1, 1), (None, 1, 1), (77, 1, 1), (ids[0], None, None)]
    good = {i for i, quality, _ in labels if i is not None and quality == 1}
    toxic = {i for i, _, mark in labels if i is not None and mark == 1}
    expected = []
    parts = sorted({row[3] or "" for row in ROWS})
    for part in parts:
        own = [(i, fails) for i, p, fails in _fails(ROWS) if p == part]
        removals, lines = Counter(), []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [m for m in left if m[1][letter]]
                left = [m for m in left if not m[1][letter]]
                failing = [m for m in own if m[1][letter]]
                removals[letter] += len(gone)
                lines.append(
                    (
                        part, order, step, len(left), len(gone), len(failing) - len(gone),
                        sum(sum(m[1].values()) == 1 for m in failing),
                        sum(m[0] in good for m in gone), sum(m[0] in toxic for m in gone),
                    )
                )
        expected += [(*line, removals[line[1][line[2] - 1]]) for line in lines]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    found = filter_audit.audit(docs, table.withColumns({"part": F.lit("x"), "_row": F.lit(1)}))
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def _conversations():
    rng = random.Random(11)
    rows = []
    for conv in [*range(60), BIG, BIG + 1, -7, -10]:
        shared = rng.random() < 0.5
        for turn in range(rng.choice([1, 2, 4, 7, 9, 13])):
            text = f"common {turn}" if shared and turn < 9 else f"own {conv} {turn} é"
            if conv % 7 == 3 and turn > 4:
                text = "tail"
            rows.append((conv, turn, "user" if turn % 2 else None, text))
    rows += [(100, None, "user", "null turn"), (100, 3, None, None), (100, 3, "", ""),
             (100, 3, "a", "tie"), (100, 3, "a", "other"), (None, 1, "user", "nobody"),
             (103, 0, "user", "common 0"), (104, 0, "us", "ercommon 0")]
    # One conversation with much of the table, and a copy of it.
    rows += [(conv, turn, "user", f"long {turn}") for conv in (200, 300) for turn in range(400)]
    rows += [(400 + 5 * n, turn, "user", f"same {turn}") for n in range(40) for turn in range(9)]
    return rows


def _expected_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            content = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own[conv].append((turn is not None, turn or 0, role, content, text))
    turns = {c: [(t[2], t[4]) for t in sorted(held)] for c, held in own.items()}
    built = {}
    for conv, held in turns.items():
        head = zlib.crc32(str(conv).encode()) % 9
        # The remainder has the sign of the id.
        first = conv - (conv % 5 if conv >= 0 else -(-conv % 5))
        built[conv] = tuple(turns.get(first, [])[:head] + held[head:])
    members = defaultdict(list)
    for conv in sorted(built):
        for depth in range(len(built[conv]) + 1):
            members[built[conv][:depth]].append(conv)
    leaves, saved, children = Counter(), Counter(), Counter()
    for path, held in members.items():
        leaf = all(len(built[c]) == len(path) for c in held)
        cost = (len(held) - 1) * len(path[-1][1].encode()) if path else 0
        for depth in range(len(path) + 1):
            leaves[path[:depth]] += leaf
            saved[path[:depth]] += cost
        if path:
            children[path[:-1]] += 1
    result = []
    for path, held in members.items():
        ends = ",".join(str(c) for c in held if len(built[c]) == len(path))
        result.append(
            (
                held[0], len(path), members[path[:-1]][0] if path else None, len(held),
                children[path], leaves[path], saved[path],
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return result


def test_prefix_trie(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 7)
    rows = _conversations()
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    clash = {name: F.lit("x") for name in ("pos", "block", "depth", "_slice", "length")}
    found = prefix_trie.prefix_trie(frame.repartition(6).withColumns(clash)).collect()
    assert Counter(map(tuple, found)) == Counter(_expected_trie(rows))


def test_agreed_blocks_are_not_refined(spark):
    rows = [(5 * n, turn, "user", f"same {turn}") for n in range(20) for turn in range(12)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    convs, moved = prefix_trie.rebuilt(prefix_trie.numbered_turns(frame))
    blocks = prefix_trie.chained_blocks(moved).cache()
    members, inner = prefix_trie.members_and_inner_nodes(blocks, convs)
    # One row per conversation and block, besides the root's; inner turns of one member only.
    assert members.where("depth > 0").count() == 20 * 3
    assert inner.count() == 3 * 3


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    turns = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert exact_dedup.exact_duplicates(docs, all_hashes=True).collect() == []
    assert filter_audit.audit(docs, labels).collect() == []
    assert prefix_trie.prefix_trie(turns).collect() == []
