"""Remove bytes that 50-byte strings of earlier documents cover, by a difference-cover sort.

1. Copies: of equal texts the document with the smallest doc_id stands for all; the others are
   covered whole (from 50 bytes on).
2. Anchors: any 50-byte string holds 33 runs of 18 bytes, and the one with the least hash is
   selected (winnowing), so equal strings share an anchor. Anchors of a single text cannot
   take part in a match; only the others are followed, each with the bytes within reach of it.
3. Difference cover, for the contexts of each anchor: positions that are 1 or 2 modulo 3 are the
   sample. Triples of 8-byte words are sorted and named, and pairs of these names are sorted and
   named again: names of 48-byte prefixes of the sampled suffixes. Any two starts have an offset
   below 3 that leads both into the sample, so the remaining suffixes are merged by the bytes up
   to the sample and the name there. Sorted so, equal 50-byte prefixes are neighbours, and the
   smallest doc_id of each run of neighbours decides which of its members are covered.
4. Starts of covered strings go back to their documents, where runs of bytes are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wheeltrace.llm.common import map_with_ids, mix, text_slices, utf8
from wheeltrace.operators.scale import materialize

STRING_BYTES = 50
GRAM = 18
# Starts of 50-byte strings that hold a given anchor.
REACH = STRING_BYTES - GRAM + 1
# A context holds all these strings, and 32 bytes more for the names at its last sample.
CONTEXT = REACH + STRING_BYTES - 1
# Contexts sorted at a time in a task.
STRETCH = 40_000
# An anchor that more texts hold is dealt out by the strings around it.
MANY_TEXTS = 4_096
# Repeated contexts a task remembers, some 200 bytes each; on reaching it, it starts afresh. More
# rows are compared then, the result is the same.
REMEMBERED = 20_000

# In `covered` of a row that packs the settled starts of a text; other values are not below 0.
PACKED = -1

_MULTIPLIER = 0x9E3779B97F4A7C15
_NO_ID = (1 << 63) - 1


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all runs of GRAM bytes, by doubling."""
    power = _MULTIPLIER
    held = {1: data.astype(np.uint64) + np.uint64(1)}
    powers = {1: power}
    for width in (1, 2, 4, 8):
        before, p = held[width], np.uint64(powers[width])
        held[2 * width] = before[:-width] * p + before[width:]
        powers[2 * width] = powers[width] * powers[width] % (1 << 64)
    n = len(data) - GRAM + 1
    return mix(held[16][:n] * np.uint64(powers[2]) + held[2][16 : 16 + n])


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """The least (or largest) of each run of `width` values, by doubling."""
    have = 1
    while 2 * have <= width:
        values, have = pick(values[:-have], values[have:]), 2 * have
    gap = width - have
    return pick(values[:-gap], values[gap:]) if gap else values


def _owners(hashes: np.ndarray) -> np.ndarray:
    """Of each run of REACH hashes the place of the leftmost least one."""
    values, places, have = hashes, np.arange(len(hashes)), 1
    while have < REACH:
        # Runs of `have` hashes, and the run after it or as far after as fits.
        gap = min(have, REACH - have)
        later = values[gap:] < values[:-gap]
        places = np.where(later, places[gap:], places[:-gap])
        values = np.where(later, values[gap:], values[:-gap])
        have += gap
    return places


def _grams(texts: list) -> tuple[np.ndarray, ...]:
    """Selected grams of all texts: hashes and positions in the joined bytes; the texts' ends,
    the joined bytes and the hashes of all grams.

    A gram is selected if it has the least hash of a run of REACH grams. Runs across two texts
    select a few more, grams across two texts never are.
    """
    data = [utf8(text) for text in texts]
    ends = np.cumsum([len(d) for d in data])
    joined = np.frombuffer(b"".join(data), np.uint8)
    if len(joined) < STRING_BYTES:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), ends, joined, np.zeros(0, np.uint64)
    hashes = _gram_hashes(joined)
    across = (ends[:-1, None] - np.arange(1, GRAM)).reshape(-1)
    hashes[across[(across >= 0) & (across < len(hashes))]] = ~np.uint64(0)
    least = _sliding(hashes, REACH, np.minimum)
    # The largest of the runs' least values that holds a gram is the gram's own if selected.
    edge = np.zeros(REACH - 1, np.uint64)
    best = _sliding(np.concatenate([edge, least, edge]), REACH, np.maximum)
    at = np.nonzero((best == hashes) & (hashes != ~np.uint64(0)))[0]
    return hashes[at], at, ends, joined, hashes


def _anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        classes = batch["class"].to_numpy()
        for part in text_slices(batch["text"]):
            hashes, at, ends, *_ = _grams(batch["text"].iloc[part].tolist())
            owner = np.searchsorted(ends, at, side="right")
            found = pd.DataFrame(
                {"gram": hashes.view(np.int64), "class": classes[part][owner]}
            )
            yield found.drop_duplicates()


def _shared_anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows sorted by gram and class, those whose gram has several classes, once each.

    `many` tells the grams of more than MANY_TEXTS classes: a gram's rows are held back until
    its end or until they exceed that number.
    """
    held = opened = None

    def told(frame: pd.DataFrame) -> pd.DataFrame:
        sizes = frame.groupby("gram")["gram"].transform("size").to_numpy()
        going = frame["gram"].to_numpy() == opened if opened is not None else False
        return frame.assign(many=(sizes > MANY_TEXTS) | going)[(sizes > 1) | going]

    for batch in batches:
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        gram, own = batch["gram"].to_numpy(), batch["class"].to_numpy()
        new = np.append(True, (gram[1:] != gram[:-1]) | (own[1:] != own[:-1]))
        batch, last = batch[new], gram[new] == gram[-1]
        yield told(batch[~last])
        held = batch[last]
        if len(held) > MANY_TEXTS or opened == gram[-1]:
            opened = gram[-1]
            yield held.iloc[:-1].assign(many=True)
            held = held.iloc[-1:]
    if held is not None:
        yield told(held)


def _by_start(low: np.ndarray, high: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces (context, low, high) of the contexts: single starts where `alone`, else all."""
    pieces = np.where(alone, high - low, 1)
    context = np.repeat(np.arange(len(low)), pieces)
    nth = np.arange(len(context)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    from_start = low[context] + nth
    return context, from_start, np.where(alone[context], from_start + 1, high[context])


def _bits(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Bits of the starts from `low` to `high`."""
    return (np.int64(1) << high.astype(np.int64)) - (np.int64(1) << low.astype(np.int64))


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes around each shared anchor, with the bounds of the starts that it owns.

    A start belongs to the leftmost least gram of its own 50 bytes, so equal strings belong to
    equal grams and each string is looked at under one anchor only. `bytes` holds what these
    strings cover, zeros elsewhere, and the two bounds. Rows that are to be compared have one
    `key`: the gram or, for a gram of many texts, the 50 bytes of a single start.

    Rows come by doc. Of equal `bytes` only the first document in reach of the task is to be
    compared: the later ones are covered whatever else there is. They go on as one row of a text,
    under a key of its own: `covered` is PACKED, `bytes` holds pairs (first, covered). What was
    met more than once is remembered up to REMEMBERED.
    """
    known: dict[bytes, int] = {}
    for batch in batches:
        for part in text_slices(batch["text"]):
            rows = batch.iloc[part]
            hashes, at, ends, joined, every = _grams(rows["text"].tolist())
            owner = np.searchsorted(ends, at, side="right")
            begins = np.append(0, ends[:-1])
            wanted, many = np.zeros(len(at), bool), np.zeros(len(at), bool)
            bounds = np.searchsorted(owner, np.arange(len(rows) + 1))
            for row, (shared, hot) in enumerate(zip(rows["grams"], rows["hot"], strict=True)):
                own = slice(bounds[row], bounds[row + 1])
                names = hashes[own].view(np.int64)
                wanted[own] = np.isin(names, np.asarray(shared, np.int64))
                if len(hot):
                    many[own] = np.isin(names, np.asarray(hot, np.int64))
            # Owners do not fall from one start to the next.
            owners = _owners(every) if len(at) else at
            low = np.maximum(np.searchsorted(owners, at, side="left"), begins[owner])
            high = np.searchsorted(owners, at, side="right")
            high = np.minimum(high, ends[owner] - STRING_BYTES + 1)
            wanted &= low < high
            if not wanted.any():
                continue
            hashes, at, owner, many = hashes[wanted], at[wanted], owner[wanted], many[wanted]
            first = at - (REACH - 1)
            context, low, high = _by_start(low[wanted] - first, high[wanted] - first, many)
            hashes, first, owner, many = (x[context] for x in (hashes, first, owner, many))
            padded = np.zeros(len(joined) + 2 * CONTEXT, np.uint8)
            padded[CONTEXT : CONTEXT + len(joined)] = joined
            cells = np.empty((len(first), CONTEXT + 2), np.uint8)
            places = np.arange(CONTEXT)
            cells[:, :CONTEXT] = padded[(first + CONTEXT)[:, None] + places]
            cells[:, :CONTEXT] *= (places >= low[:, None]) & (
                places < high[:, None] + STRING_BYTES - 1
            )
            cells[:, CONTEXT], cells[:, CONTEXT + 1] = low, high
            joined_cells, width = cells.tobytes(), CONTEXT + 2
            held = np.empty(len(first), object)
            held[:] = [joined_cells[k : k + width] for k in range(0, len(joined_cells), width)]
            codes, distinct = pd.factorize(held)
            docs, classes = rows["doc"].to_numpy()[owner], rows["class"].to_numpy()[owner]
            smallest = np.array([known.get(own, _NO_ID) for own in distinct], np.int64)
            np.minimum.at(smallest, codes, docs)
            for code in np.nonzero(np.bincount(codes) > 1)[0]:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[distinct[code]] = int(smallest[code])
            settled = docs > smallest[codes]
            keys = hashes.copy()
            keys[many] = pd.util.hash_array(held[many], categorize=False)
            firsts = first - begins[owner]
            yield pd.DataFrame(
                {
                    "key": keys.view(np.int64),
                    "doc": docs,
                    "class": classes,
                    "first": firsts,
                    "covered": 0,
                    "bytes": held,
                }
            )[~settled]
            if settled.any():
                bits = _bits(low[settled], high[settled])
                yield _packed(docs[settled], classes[settled], firsts[settled], bits, owner[settled])


def _packed(
    docs: np.ndarray, classes: np.ndarray, firsts: np.ndarray, bits: np.ndarray, owner: np.ndarray
) -> pd.DataFrame:
    """Settled starts as one row of each text; rows of a text, told by `owner`, stand together."""
    begin = np.nonzero(np.append(True, owner[1:] != owner[:-1]))[0]
    pairs = np.stack([firsts, bits], axis=1).astype("<i8")
    keys = mix(docs[begin].view(np.uint64) + mix(classes[begin].view(np.uint64)))
    return pd.DataFrame(
        {
            "key": keys.view(np.int64),
            "doc": docs[begin],
            "class": classes[begin],
            "first": 0,
            "covered": PACKED,
            "bytes": [own.tobytes() for own in np.split(pairs, begin[1:])],
        }
    )


def _unpacked(rows: pd.DataFrame) -> pd.DataFrame:
    """(doc, class, first, covered) of each start in packed rows."""
    pairs = np.frombuffer(b"".join(rows["bytes"]), "<i8").reshape(-1, 2)
    each = rows["bytes"].map(len).to_numpy() // 16
    return pd.DataFrame(
        {
            "doc": np.repeat(rows["doc"].to_numpy(), each),
            "class": np.repeat(rows["class"].to_numpy(), each),
            "first": pairs[:, 0],
            "covered": pairs[:, 1],
        }
    )


def _ranks(values: np.ndarray) -> np.ndarray:
    """Dense ranks of the values, by sorting."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.zeros(len(order), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(new)
    return ranks


def _names(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of the tuples, by sorting.

    Parts of a tuple (not below 0) are put side by side in one number as far as they fit, the
    higher ones replaced by their ranks, as numpy sorts single numbers several times faster.
    """
    whole, span = np.zeros(len(keys[0]), np.int64), 1
    for key in keys if len(whole) else ():
        width = int(key.max()) + 1
        if width > 1 << 31:
            key = _ranks(key)
            width = int(key.max()) + 1
        if span * width >= 1 << 63:
            whole = _ranks(whole)
            span = int(whole.max()) + 1
        whole = whole * width + key.astype(np.int64)
        span *= width
    return _ranks(whole)


def least_ids(
    cells: np.ndarray, docs: np.ndarray, low: np.ndarray, high: np.ndarray
) -> np.ndarray:
    """(contexts, starts): the smallest id with the same 50 bytes at a start of the same gram.

    `docs` has the id of each context; its starts are those from `low` to `high`, and only
    these, with the samples they lead to, are sorted. Elsewhere the result is the largest long.

    Equal 50-byte strings in different groups of grams are not compared: strings that share a
    gram meet in its own group.
    """
    m = len(cells)
    wide = np.zeros((m, CONTEXT + 32), np.uint8)
    wide[:, :CONTEXT] = cells
    places = np.arange(CONTEXT + 8)
    # Sampled positions: those of a start or up to two bytes on, and 24 bytes after each.
    reached = (places >= low[:, None]) & (places < high[:, None] + 2) & (places % 3 != 0)
    named = reached.copy()
    named[:, 24:] |= reached[:, :-24]
    words = np.zeros((m, CONTEXT + 8), np.uint64)
    for k in range(8):
        own = words[:, k::8]
        own[:] = np.ascontiguousarray(wide[:, k : k + 8 * own.shape[1]]).view(">u8")
    row, spot = np.nonzero(named)
    names = np.zeros((m, CONTEXT + 8), np.int64)
    names[row, spot] = _names(*[words[row, spot + 8 * k] for k in range(3)])
    deep = np.zeros((m, CONTEXT + 8), np.int64)
    row, spot = np.nonzero(reached)
    deep[row, spot] = _names(names[row, spot], names[row, spot + 24])
    least = np.full((m, REACH), _NO_ID)
    # All contexts of a gram have it at the same place.
    group = _names(*[words[:, REACH - 1 + k] for k in (0, 8, GRAM - 8)])
    starts = np.arange(REACH)
    real = (starts >= low[:, None]) & (starts < high[:, None])
    for offset in range(3):
        row, start = np.nonzero(real & ((starts + offset) % 3 != 0))
        if not len(row):
            continue
        # The bytes before the sampled position and after its 48.
        rest = np.zeros(len(row), np.int64)
        for k in [*range(offset), *range(offset + 48, STRING_BYTES)]:
            rest = rest * 256 + cells[row, start + k]
        keys = _names(group[row], deep[row, start + offset], rest)
        lowest = np.full(keys.max() + 1, _NO_ID)
        np.minimum.at(lowest, keys, docs[row])
        least[row, start] = np.minimum(least[row, start], lowest[keys])
    return least


def _covered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(doc, class, first, covered): bits of the starts that an earlier document has too.

    Rows are sorted by key and id. A stretch ends with a key. Where one key fills more than
    a stretch, its distinct contexts so far, with their smallest ids, go into the next one.
    Keys of more than MANY_TEXTS texts are single strings, so these are few.
    """
    seen = None
    held: list[pd.DataFrame] = []
    count = 0
    results = ["doc", "class", "first", "covered"]

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        docs, starts = frame["doc"].to_numpy(), np.arange(REACH)
        # Copies of a passage have equal contexts: each is sorted once.
        codes, distinct = pd.factorize(frame["bytes"])
        cells = np.frombuffer(b"".join(distinct), np.uint8).reshape(-1, CONTEXT + 2)
        low, high = cells[:, CONTEXT].astype(np.int64), cells[:, CONTEXT + 1].astype(np.int64)
        smallest = np.full(len(distinct), _NO_ID)
        np.minimum.at(smallest, codes, docs)
        least = least_ids(cells[:, :CONTEXT], smallest, low, high)
        hit = least[codes] < docs[:, None]
        bits = (hit.astype(np.int64) << starts).sum(axis=1)
        keep = (bits != 0) & (frame["fresh"].to_numpy())
        return frame.assign(covered=bits).loc[keep, results]

    def ready(frame: pd.DataFrame):
        nonlocal seen
        whole = frame if seen is None else pd.concat([seen, frame], ignore_index=True)
        seen = None
        return work(whole), whole

    for batch in batches:
        settled = batch["covered"] == PACKED
        if settled.any():
            yield _unpacked(batch[settled])
        batch = batch[~settled].assign(fresh=True)
        for start in range(0, len(batch), STRETCH):
            held.append(batch.iloc[start : start + STRETCH])
            count += len(held[-1])
            if count < STRETCH:
                continue
            frame = pd.concat(held, ignore_index=True)
            last = frame["key"].to_numpy() == frame["key"].iloc[-1]
            if last.all():
                found, whole = ready(frame)
                yield found
                whole = whole.sort_values("doc", kind="stable").assign(fresh=False)
                seen = whole.drop_duplicates(["key", "bytes"])
                held, count = [], 0
            else:
                yield ready(frame[~last])[0]
                held, count = [frame[last]], int(last.sum())
    if held:
        yield ready(pd.concat(held, ignore_index=True))[0]


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text, copied, firsts, masks in zip(
            batch["text"], batch["copied"], batch["firsts"], batch["masks"], strict=True
        ):
            data = utf8(text)
            n = len(data)
            if copied and n >= STRING_BYTES:
                rows.append((n, n, 1, b""))
                continue
            if firsts is None or not len(firsts):
                rows.append((n, 0, 0, data))
                continue
            hit = (np.asarray(masks)[:, None] >> np.arange(REACH)) & 1
            starts = (np.asarray(firsts)[:, None] + np.arange(REACH))[hit == 1]
            change = np.zeros(n + 1, np.int64)
            np.add.at(change, starts, 1)
            np.add.at(change, starts + STRING_BYTES, -1)
            gone = np.cumsum(change[:-1]) > 0
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            rows.append((n, int(gone.sum()), spans, kept))
        out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])
        out.insert(0, "doc_id", batch["doc_id"])
        yield out


def cut_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary) of every row of `docs`.

    A byte is removed if a 50-byte string covers it that also starts in a document with a
    smaller doc_id; strings are judged on the input. `kept` is what remains, which may split a
    character. Null and empty texts, and texts below 50 bytes, lose nothing. A null doc_id
    counts as larger than all others. Rows with one doc_id, or without any, do not remove each
    other's bytes, whether their texts are equal or not. An empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        F.coalesce("doc_id", F.lit(_NO_ID - 1)).alias("doc"),
        text.alias("text"),
        # 128 bits name a class of equal texts.
        F.concat(F.hex(F.xxhash64(text)), F.hex(F.xxhash64(F.lit("other"), text))).alias("copies"),
        F.xxhash64(text).alias("class"),
    )
    first = materialize(
        rows.groupBy("copies", "class").agg(F.min("doc").alias("_first")),
        "first-copies",
        free_shuffles=True,
    )
    grams = materialize(
        rows.select("class", "text")
        .mapInPandas(_anchors, "gram bigint, class bigint")
        .repartition("gram")
        .sortWithinPartitions("gram", "class")
        .mapInPandas(_shared_anchors, "gram bigint, class bigint, many boolean"),
        "anchors",
        free_shuffles=True,
    )
    # At most one gram per byte of a text.
    per_class = grams.groupBy("class").agg(
        F.collect_set("gram").alias("grams"), F.collect_set(F.expr("IF(many, gram, NULL)")).alias("hot")
    )
    leaders = first.join(per_class, "class").select(
        F.col("_first").alias("doc"), "copies", "grams", "hot"
    )
    # Texts that share a doc_id, or have none, are told apart by their class. They are written,
    # so their shuffle is off the disk before that of the contexts, and a repeated task does the
    # same.
    followed = materialize(
        rows.join(leaders, ["doc", "copies"])
        .select("doc", "text", "copies", "class", "grams", "hot")
        .dropDuplicates(["doc", "copies"])
        # Already so.
        .sortWithinPartitions("doc", "copies")
        .drop("copies"),
        "followed",
        free_shuffles=True,
    )
    covered = (
        followed.mapInPandas(
            _contexts,
            "key bigint, doc bigint, class bigint, first bigint, covered bigint, bytes binary",
        )
        .repartition("key")
        .sortWithinPartitions("key", "doc")
        .mapInPandas(_covered, "doc bigint, class bigint, first bigint, covered bigint")
    )
    cuts = materialize(
        covered.groupBy("doc", "class").agg(
            F.collect_list("first").alias("firsts"), F.collect_list("covered").alias("masks")
        ),
        "cuts",
        free_shuffles=True,
    )
    fate = rows.select("doc", "copies").join(first, "copies").select(
        "doc", "copies", "class", (F.col("_first") < F.col("doc")).alias("copied")
    )
    fate = fate.distinct().join(cuts, ["doc", "class"], "left").drop("class")
    # What becomes of a document is joined to its text, which is shuffled once here.
    return map_with_ids(
        rows.join(fate, ["doc", "copies"]),
        ["text", "copied", "firsts", "masks"],
        _cut,
        "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary",
    )
