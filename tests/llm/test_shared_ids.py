"""op7 on rows that share a doc_id, or have none, and differ in their texts."""

import random

from wheeltrace.llm import suffix_dedup


def test_cuts_stay_with_their_text(spark):
    rng = random.Random(4)

    def prose(n):
        return "".join(rng.choices("abcdefghijklmnop ", k=n))

    passage, other = prose(50), prose(70)
    texts = [
        (1, prose(200) + passage + prose(100)),
        (2, other + prose(300)),
        # Starts found in the first lie beyond the second.
        (None, prose(1000) + passage + prose(400)),
        (None, prose(60)),
        (5, prose(30) + other + prose(500)),
        (5, prose(900) + passage),
        (5, prose(55)),
        (5, prose(45) + passage + other),
        (None, prose(1500) + other),
        (None, prose(1500)),
        (None, None),
    ]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    found = suffix_dedup.cut_repeats(frame).collect()

    def expected(doc_id, text):
        data = (text or "").encode()
        earlier = [
            t.encode() for d, t in texts if t and d is not None and (doc_id is None or d < doc_id)
        ]
        gone = bytearray(len(data))
        for k in range(len(data) - 49):
            if any(data[k : k + 50] in e for e in earlier):
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        return doc_id is None, doc_id or 0, len(data), sum(gone), kept

    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, bytes(r.kept)) for r in found) == sorted(
        expected(*row) for row in texts
    )
