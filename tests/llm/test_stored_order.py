"""The order of the mixture survives storing: packing numbers its sequences along it."""

import random
import sys
from pathlib import Path
from types import SimpleNamespace
from urllib.parse import urlparse

import corpus_pipeline
import pandas as pd
from pyspark.sql import functions as F

from wheeltrace.llm import mixing, packing, tokens
from wheeltrace.llm.common import tokenizer_path
from wheeltrace.operators.scale import materialize


def test_sequences_follow_the_mixture_over_files_of_unequal_size(spark):
    rng = random.Random(9)
    # Source a compresses well and comes first; what is left of b makes larger files.
    rows = [(n, "same " * 60, "a") for n in range(300)]
    rows += [(n, "".join(rng.choices("abcdefghij ", k=300)), "b") for n in range(300, 600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    mixing_targets = {"weights": {"a": 0.9, "b": 0.1}, "block_bytes": 2000}
    places = {r.doc_id: (r.slot, r["at"]) for r in mixing.mix(docs, **mixing_targets).collect()}
    stored = materialize(
        mixing.mixed_order(docs, partition_bytes=20_000, **mixing_targets), "unequal"
    )
    files = sorted(stored.inputFiles())
    sizes = [Path(urlparse(f).path).stat().st_size for f in files]
    assert len(files) > 5 and sizes != sorted(sizes, reverse=True)
    pieces = corpus_pipeline.pack_windows(spark, stored, "").where("start = 0")
    ordered = pieces.orderBy("sequence_id", "offset").select("doc_id").collect()
    assert [r.doc_id for r in ordered] == sorted(places, key=places.get)


def test_parts_are_ordered_by_number(spark, tmp_path):
    from wheeltrace.operators.scale import stored_order

    for number in (99999, 100000):
        folder = str(tmp_path / f"one-{number}")
        spark.range(number, number + 3, 1, 1).write.parquet(folder)
        (part,) = Path(folder).glob("part-*.parquet")
        (tmp_path / "all").mkdir(exist_ok=True)
        (tmp_path / "all" / f"part-{number}-x.parquet").write_bytes(part.read_bytes())
    found = stored_order(spark.read.parquet(str(tmp_path / "all")))
    rows = found.withColumn("task", F.spark_partition_id()).collect()
    assert [r.id for r in sorted(rows, key=lambda r: r.task)] == [99999, 100000, 100001, 100000, 100001, 100002]


def test_pipeline_workers_keep_few_words(monkeypatch):
    """What a worker keeps from task to task, and a slice it handles, follow the given limit."""
    path = tokenizer_path()
    monkeypatch.delitem(sys.modules, "_words_of_worker", raising=False)
    encode = tokens.word_encoder(path, 50)
    texts = [" ".join(f"a{k}b" for k in range(n, n + 40)) for n in range(0, 400, 40)]
    few = [encode([text])[0].tolist() for text in texts]
    kept = sys.modules["_words_of_worker"].words
    assert len(kept.known) <= 50
    encode = tokens.word_encoder(path)
    assert [encode([text])[0].tolist() for text in texts] == few
    assert len(kept.known) == 400
    assert corpus_pipeline.CACHED_WORDS * 700 < 1.1e8


def test_packing_slices_follow_the_cached_words(monkeypatch):
    """More characters in a slice for packing alone, where a worker may keep more words."""
    limits = []
    slices = packing.text_slices
    monkeypatch.setattr(
        packing, "text_slices", lambda texts, limit=None: limits.append(limit) or slices(texts, limit)
    )
    monkeypatch.setattr(
        packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0))
    )
    rows = pd.DataFrame({"doc_id": ["1", "2", "3"], "text": ["One. Two three.", None, "Four"]})
    found = []
    for words in (1, 800_000):
        found.append(pd.concat(packing._pack(tokenizer_path(), 2048, words)(iter([rows]))))
    assert limits == [10, 8_000_000]
    assert found[0].equals(found[1])


def test_words_split_as_bytes_do():
    """Words per text and their order, also with empty, null and padded texts."""
    draw = random.Random(5)
    signs = " \t\n\x0b\x0c\r\x1c\x1f\x00\x85\xa0\u2003aé."
    texts = ["", None, " ", "a", " a  b "]
    texts += ["".join(draw.choices(signs, k=draw.randrange(12))) for _ in range(400)]
    codes, distinct, counts = tokens._split(texts)
    own = [(text or "").encode().split() for text in texts]
    assert counts.tolist() == [len(words) for words in own]
    assert distinct[codes].tolist() == [word for words in own for word in words]
    assert tokens._split([])[2].tolist() == tokens._split([None])[2].tolist()[1:] == []
