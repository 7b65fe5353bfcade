"""Benchmark passages in documents, within an edit budget.

By the q-gram lemma, a passage of L characters found with at most e edits shares
at least L - q + 1 - q e of its q-grams with the text, on diagonals that differ
by at most e. Shared q-grams are counted in overlapping bands of diagonals of
each passage; bands that meet the bound are verified by a banded alignment.
Long items are cut into overlapping passages, at most twice the edit budget
apart, so that a verbatim part of PASSAGE bytes is within the budget of one
wherever it starts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidflow.llm.common import LOWER, SLICE_BYTES, WHITE, bounded_batches, extended, flat, pieces, total

Q = 8
EDITS = 0.1
PASSAGE = 120
BLOCK_BYTES = 4 << 20
FOUND = "array<struct<item_id:bigint,start:bigint,edits:int>>"


def plain(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with A-Z lower-cased and each run of ASCII white space as one blank."""
    out, white = LOWER[data], WHITE[data]
    out[white] = 32
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = ~(white[1:] & white[:-1])
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True
    return out[keep], np.append(0, np.cumsum(keep))[offsets]


def codes(data: np.ndarray) -> np.ndarray:
    """The q-gram at every position, as a number; q is 8, so that they are told apart exactly."""
    x = data.astype(np.uint64)
    for step in (1, 2, 4):
        if len(x) <= step:
            return np.zeros(0, dtype=np.uint64)
        x = (x[:-step] << np.uint64(8 * step)) | x[step:]
    return x


@dataclass(frozen=True)
class Index:
    """Passages with their item, edit budget and least number of shared q-grams, and where each q-gram occurs."""

    items: np.ndarray
    offsets: np.ndarray
    passages: list[bytes]
    budget: np.ndarray
    least: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    at_passage: np.ndarray
    at_offset: np.ndarray
    filter: np.ndarray
    shift: np.uint64


def passages_of(text: bytes, edits: float = EDITS) -> list[tuple[int, bytes]]:
    """(offset, passage): the whole of a short item, overlapping passages of a long one.

    An excerpt of PASSAGE bytes is at most half a stride off some passage and lacks that many of its bytes.
    """
    if len(text) <= PASSAGE:
        return [(0, text)]
    stride = max(1, 2 * min(int(edits * PASSAGE), (PASSAGE - Q) // Q))
    starts = [*range(0, len(text) - PASSAGE, stride), len(text) - PASSAGE]
    return [(s, text[s : s + PASSAGE]) for s in dict.fromkeys(starts)]


def index_of(items: list[tuple[int, str]], edits: float = EDITS) -> Index:
    """Of (item_id, text); items shorter than a q-gram are no passages and never found."""
    ids, offsets, texts = [], [], []
    for item_id, text in items:
        raw = plain(*flat(pa.array([text])))[0].tobytes().strip()
        for offset, passage in passages_of(raw, edits):
            if len(passage) >= Q:
                ids.append(item_id)
                offsets.append(offset)
                texts.append(passage)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    # No more edits than leave one q-gram to be shared.
    budget = np.minimum((edits * lengths).astype(np.int64), (lengths - Q) // Q)
    grams = [codes(np.frombuffer(t, dtype=np.uint8)) for t in texts]
    every = np.concatenate([np.zeros(0, dtype=np.uint64), *grams])
    order = np.argsort(every, kind="stable")
    unique, first = np.unique(every[order], return_index=True)
    passage = np.repeat(np.arange(len(texts)), [len(g) for g in grams])
    offset = np.concatenate([np.zeros(0, dtype=np.int64), *[np.arange(len(g)) for g in grams]])
    bits = int(np.clip(np.ceil(np.log2(16 * max(len(unique), 1))), 16, 26))
    shift = np.uint64(64 - bits)
    table = np.zeros(1 << bits, dtype=bool)
    table[spread(unique) >> shift] = True
    return Index(
        np.array(ids, dtype=np.int64), np.array(offsets, dtype=np.int64), texts, budget,
        lengths - Q + 1 - Q * budget, unique, np.append(first, len(every)), passage[order], offset[order], table, shift,
    )


def spread(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return x * np.uint64(0x9E3779B97F4A7C15)


def edits_of(passage: bytes, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int]:
    """(least edits, start) of ``passage`` in ``text`` on the diagonals low to high; any beginning and end is free."""
    begin, end = max(low, 0), min(high + len(passage), len(text))
    exact = text[begin:end].tobytes().find(passage)
    if exact >= 0:
        return 0, begin + exact
    letters = np.frombuffer(passage, dtype=np.uint8)
    diagonals = np.arange(low, high + 1)
    padded = np.zeros(high - low + 1 + len(passage), dtype=np.int16)
    inside = slice(max(0, -low), max(0, min(len(padded), len(text) - low)))
    padded[inside] = text[low + inside.start : low + inside.stop]
    n, steps = len(diagonals), np.arange(len(diagonals))
    outside = len(passage) + budget + 1
    # cost[d]: edits of the letters so far against the text ending at diagonal d; beyond the text is out of reach.
    cost = np.where((diagonals >= 0) & (diagonals <= len(text)), 0, outside)
    for i, letter in enumerate(letters.tolist(), 1):
        there = diagonals + i
        new = cost + (padded[i - 1 : i - 1 + n] != letter)
        new[:-1] = np.minimum(new[:-1], cost[1:] + 1)
        new = np.where((there < 0) | (there > len(text)), outside, new)
        cost = np.minimum.accumulate(new - steps) + steps
        if i % 8 == 0 and cost.min() > budget:
            return int(cost.min()), -1
    best = int(cost.argmin())
    return int(cost[best]), max(0, int(diagonals[best]))


def found_in(texts: pa.Array, index: Index) -> list[list[dict]]:
    """Of each text, the items found: item_id, start in the plain text, edits; each item once, at its best passage."""
    out: list[dict[int, dict]] = [{} for _ in range(len(texts))]
    data, offsets = plain(*flat(texts))
    # Slices overlap by a q-gram; hits are gathered, so that a long text is seen whole.
    hits = []
    for low in range(0, len(data), SLICE_BYTES):
        x = codes(data[low : low + SLICE_BYTES + Q - 1])
        at = np.flatnonzero(index.filter[spread(x) >> index.shift]) if len(index.grams) else np.zeros(0, dtype=np.int64)
        gram = np.minimum(np.searchsorted(index.grams, x[at]), max(len(index.grams) - 1, 0))
        same = index.grams[gram] == x[at] if len(at) else np.zeros(0, dtype=bool)
        hits.append((at[same] + low, gram[same]))
    if not hits:
        return [[] for _ in out]
    at, gram = (np.concatenate([h[k] for h in hits]) for k in (0, 1))
    doc = np.searchsorted(offsets, at, "right") - 1
    whole = at + Q <= offsets[doc + 1]
    at, gram, doc = at[whole], gram[whole], doc[whole]
    n = index.first[gram + 1] - index.first[gram] if len(gram) else np.zeros(0, dtype=np.int64)
    place = np.repeat(index.first[gram] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum()) if len(gram) else n
    passage = index.at_passage[place]
    doc = np.repeat(doc, n)
    width = np.maximum(index.budget, 1)[passage]
    diagonal = np.repeat(at, n) - offsets[doc] - index.at_offset[place] + PASSAGE * 4
    bands = np.concatenate([diagonal // (2 * width) * 2, (diagonal + width) // (2 * width) * 2 + 1])
    pair = np.tile(doc * len(index.passages) + passage, 2)
    most = int(bands.max(initial=0)) + 1
    # The bound is on q-grams of the passage: one that a text repeats counts once.
    offset = np.tile(index.at_offset[place], 2)
    each = np.sort((pair * most + bands) * PASSAGE + offset)
    each = each[np.append(True, each[1:] != each[:-1])[: len(each)]] // PASSAGE
    first = np.flatnonzero(np.append(True, each[1:] != each[:-1])) if len(each) else np.zeros(0, dtype=np.int64)
    keys, shared = each[first], np.diff(np.append(first, len(each)))
    pair, band = keys // most, keys % most
    good = shared >= index.least[pair % max(len(index.passages), 1)] if len(keys) else np.zeros(0, dtype=bool)
    for d, p, b in zip(*(x[good].tolist() for x in (pair // max(len(index.passages), 1), pair % max(len(index.passages), 1), band)), strict=True):
        item, budget = int(index.items[p]), int(index.budget[p])
        known = out[d].get(item)
        if known is not None and known["edits"] == 0:
            continue
        wide = max(budget, 1)
        low = (b // 2) * 2 * wide - (wide if b % 2 else 0) - PASSAGE * 4
        text = data[offsets[d] : offsets[d + 1]]
        edits, start = edits_of(index.passages[p], text, low - budget, low + 2 * wide + budget, budget)
        if edits <= budget and (known is None or edits < known["edits"]):
            out[d][item] = {"item_id": item, "start": start, "edits": edits}
    return [[x[k] for k in sorted(x)] for x in out]


def with_leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``leaks``: the items of ``benchmark`` (item_id, text) found in each text, by item_id.

    The benchmark is read by the driver in blocks of about ``block_bytes``, each
    compared with all texts, so it may be of any size. Characters are bytes of
    UTF-8, lower-cased where they are A-Z, white space as single blanks. Null or
    empty texts have no leaks; null items and those of less than eight
    characters are never found. Every row is kept, repeated or not; other
    columns pass through, but one named leaks is replaced.
    """
    bounded_batches(docs.sparkSession)
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint"), "text")
    n_blocks = max(1, -(-int(total(items, F.sum(F.octet_length("text")))) // block_bytes))
    rest = docs.drop("leaks")
    schema = extended(rest.schema, leaks=FOUND)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("edits", pa.int32())]))
    out = None
    for block in range(n_blocks):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).distinct().collect()
        own = sorted((r["item_id"], r["text"]) for r in some)

        def search(batches: Iterator[pa.RecordBatch], own=own, first=out is None) -> Iterator[pa.RecordBatch]:
            index = index_of(own, edits)
            for batch in pieces(batches, "text", SLICE_BYTES):
                found = found_in(batch.column("text"), index)
                columns = batch.columns
                if not first:
                    best = [{x["item_id"]: x for x in old} for old in columns.pop().to_pylist()]
                    for old, new in zip(best, found, strict=True):
                        for x in new:
                            if x["item_id"] not in old or x["edits"] < old[x["item_id"]]["edits"]:
                                old[x["item_id"]] = x
                    found = [[x[k] for k in sorted(x)] for x in best]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kind)], names=schema.names)

        out = (rest if out is None else out).mapInArrow(search, schema)
    return out
