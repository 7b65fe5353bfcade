"""Language model scores by a weighted backoff automaton.

A bigram model with interpolated Witten-Bell smoothing. Every word seen in
training, and the start of a text, is a state. A state has an arc for each word
that followed it, with the log of its smoothed probability, and a failure arc to
the root, whose arcs are smoothed word probabilities. A text is read once from
left to right, one arc, or the failure arc and a root arc, for each token.

No task holds the whole model. Texts are kept in blocks of word numbers; each
block asks the shards, which own the counts of their states, for the part of the
automaton its texts can reach. What the shards see are sorted unique pairs of a
block, never single tokens, and states with a large share of all tokens are
spread over all shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidflow.llm.common import bounded_batches, flat, mixed, pieces, total, word_hashes
from bidflow.shared import staged

BLOCK_BYTES = 6 << 20
SHARD_TOKENS = 2_000_000
HEAVY = 64  # a state with more than 1 / HEAVY of all training tokens is spread; there are fewer than HEAVY
WORD_BITS = 40
START, END = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)

BODY = (
    "block bigint, doc_ids array<bigint>, held_out array<boolean>, sizes array<int>, vocabulary binary, words binary,"
    " n_tokens bigint, train_docs bigint, train_tokens bigint, heavy array<struct<state:bigint,n:bigint>>"
)
ASKED = "shard int, block bigint, states binary, runs binary, low binary, high binary, counts binary"
TOLD = (
    "shard int, block bigint, counts binary, state_counts binary, state_kinds binary,"
    " known bigint, heavy array<struct<state:bigint,n:bigint,kinds:bigint>>"
)
SCORED = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint,"
    " base_score double, score double"
)


def pack(values: np.ndarray) -> bytes:
    return len(values).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(values).tobytes(), "zstd", asbytes=True)


def unpack(data: bytes, kind) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], n * np.dtype(kind).itemsize, "zstd", asbytes=True), dtype=kind)


@dataclass
class Block:
    """Texts as word numbers; ``vocabulary`` has the hash of each number, most frequent first."""

    doc_ids: list
    held_out: np.ndarray
    sizes: np.ndarray
    vocabulary: np.ndarray
    words: np.ndarray

    def hashes(self) -> np.ndarray:
        """Of all words, then of the start and the end of a text."""
        return np.concatenate([self.vocabulary, np.array([START, END], dtype=np.uint64)])

    def tokens(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, state, token) of every token; the last token of a text is its end."""
        n, docs = len(self.vocabulary), len(self.sizes)
        doc = np.repeat(np.arange(docs), self.sizes + 1)
        ends = np.cumsum(self.sizes + 1) - 1
        token = np.empty(len(doc), dtype=np.int64)
        is_end = np.zeros(len(doc), dtype=bool)
        is_end[ends] = True
        token[is_end] = n + 1
        token[~is_end] = self.words
        state = np.empty(len(doc), dtype=np.int64)
        state[1:] = token[:-1]
        state[ends - self.sizes] = n
        return doc, state, token

    def pairs(self, shards: int, heavy: np.ndarray) -> tuple[np.ndarray, ...]:
        """Distinct (state, token) by shard, each token's pair, text of each token, and the shard bounds."""
        doc, state, token = self.tokens()
        n = len(self.vocabulary) + 2
        unique, at = np.unique(state * n + token, return_inverse=True)
        states, tokens, h = unique // n, unique % n, self.hashes()
        place = mixed(h[states])
        spread = np.isin(h, heavy)[states]
        place[spread] = mixed(place[spread] ^ h[tokens[spread]])
        shard = (place % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        new = np.empty(len(order), dtype=np.int64)
        new[order] = np.arange(len(order))
        bounds = np.searchsorted(shard[order], np.arange(shards + 1))
        return states[order], tokens[order], new[at], doc, bounds


def runs_of(states: np.ndarray) -> np.ndarray:
    """Where a run of equal states begins."""
    return np.flatnonzero(np.append(True, states[1:] != states[:-1])) if len(states) else np.zeros(0, dtype=np.int64)


def block_of(row: dict) -> Block:
    planes = unpack(row["words"], np.uint8).reshape(3, -1).astype(np.int64)
    return Block(
        row["doc_ids"],
        np.array(row["held_out"], dtype=bool),
        np.array(row["sizes"], dtype=np.int64),
        unpack(row["vocabulary"], np.uint64),
        planes[0] | planes[1] << 8 | planes[2] << 16,
    )


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of BODY from (doc_id, text, held_out): whole texts, about ``block_bytes`` of them each."""

    def body(block: int, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        texts = pa.concat_arrays([b.column("text") for b in batches])
        doc_ids = [i for b in batches for i in b.column("doc_id").to_pylist()]
        held_out = np.array([x for b in batches for x in b.column("held_out").to_pylist()], dtype=bool)
        data, offsets = flat(texts)
        h, sizes, _ = word_hashes(data, offsets)
        vocabulary, at, n = np.unique(h, return_inverse=True, return_counts=True)
        rank = np.argsort(-n, kind="stable")
        number = np.empty(len(rank), dtype=np.int64)
        number[rank] = np.arange(len(rank))
        words = number[at]
        if len(rank) >= 1 << 24:
            raise ValueError("a block has too many different words; lower block_bytes")
        made = Block(doc_ids, held_out, sizes, vocabulary[rank], words)
        doc, state, _ = made.tokens()
        seen = np.bincount(state[~held_out[doc]], minlength=len(rank) + 2)
        large = np.flatnonzero(seen * HEAVY > seen.sum())
        heavy = [{"state": int(s), "n": int(c)} for s, c in zip(made.hashes()[large].view(np.int64), seen[large], strict=True)]
        row = {
            "block": block,
            "doc_ids": doc_ids,
            "held_out": held_out.tolist(),
            "sizes": sizes.tolist(),
            "vocabulary": pack(made.vocabulary),
            "words": pack(np.concatenate([words & 255, (words >> 8) & 255, words >> 16]).astype(np.uint8)),
            "n_tokens": len(doc),
            "train_docs": int((~held_out).sum()),
            "train_tokens": int(seen.sum()),
            "heavy": heavy,
        }
        return pa.RecordBatch.from_pylist([row], schema=BODY_ARROW)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        some, size = [], 0
        for batch in pieces(batches, "text", block_bytes):
            some.append(batch.set_column(1, "text", batch.column("text").fill_null("")))
            size += batch.column("text").nbytes
            if size >= block_bytes:
                yield body(block, some)
                some, size, block = [], 0, block + 1
        if some:
            yield body(block, some)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "held_out")
    return rows.mapInArrow(gathered, BODY)


BODY_ARROW = pa.schema(
    [
        ("block", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("held_out", pa.list_(pa.bool_())),
        ("sizes", pa.list_(pa.int32())),
        ("vocabulary", pa.binary()),
        ("words", pa.binary()),
        ("n_tokens", pa.int64()),
        ("train_docs", pa.int64()),
        ("train_tokens", pa.int64()),
        ("heavy", pa.list_(pa.struct([("state", pa.int64()), ("n", pa.int64())]))),
    ]
)
ASKED_ARROW = pa.schema(
    [("shard", pa.int32()), ("block", pa.int64()), *[(n, pa.binary()) for n in ("states", "runs", "low", "high", "counts")]]
)
TOLD_ARROW = pa.schema(
    [
        ("shard", pa.int32()),
        ("block", pa.int64()),
        ("counts", pa.binary()),
        ("state_counts", pa.binary()),
        ("state_kinds", pa.binary()),
        ("known", pa.int64()),
        ("heavy", pa.list_(pa.struct([("state", pa.int64()), ("n", pa.int64()), ("kinds", pa.int64())]))),
    ]
)


def asked(bodies: DataFrame, shards: int, heavy: np.ndarray) -> DataFrame:
    """Of each block, the pairs it has of each shard with their counts in training texts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = block_of(row)
                states, tokens, at, doc, bounds = b.pairs(shards, heavy)
                h = b.hashes()
                counts = np.bincount(at[~b.held_out[doc]], minlength=len(states)).astype(np.uint32)
                for shard in range(shards):
                    low, high = bounds[shard], bounds[shard + 1]
                    if low == high:
                        continue
                    s, w = states[low:high], h[tokens[low:high]] & np.uint64((1 << WORD_BITS) - 1)
                    begin = runs_of(s)
                    values = {
                        "states": pack(h[s[begin]]),
                        "runs": pack(np.diff(np.append(begin, len(s))).astype(np.uint32)),
                        "low": pack(w.astype(np.uint32)),
                        "high": pack((w >> np.uint64(32)).astype(np.uint8)),
                        "counts": pack(counts[low:high]),
                    }
                    yield pa.RecordBatch.from_pylist([{"shard": shard, "block": row["block"], **values}], schema=ASKED_ARROW)

    return bodies.select("block", "doc_ids", "held_out", "sizes", "vocabulary", "words").mapInArrow(ask, ASKED)


def told(questions: DataFrame, heavy: np.ndarray) -> DataFrame:
    """Of each shard, the counts to every question in its order, and (block null) what it has in all."""

    def tell(cells: pa.Table) -> pa.Table:
        shard, rows = cells.column("shard")[0].as_py(), cells.num_rows

        def all_of(name: str, kind) -> tuple[np.ndarray, np.ndarray]:
            parts = [unpack(x.as_py(), kind) for x in cells.column(name)]
            return np.concatenate(parts), np.cumsum([0, *map(len, parts)])

        states, state_bounds = all_of("states", np.uint64)
        runs, _ = all_of("runs", np.uint32)
        low, pair_bounds = all_of("low", np.uint32)
        high, _ = all_of("high", np.uint8)
        counts, _ = all_of("counts", np.uint32)
        own, number = np.unique(states, return_inverse=True)
        if len(own) >= 1 << (64 - WORD_BITS):
            raise ValueError("a shard has too many states; lower SHARD_TOKENS")
        pair = np.repeat(number, runs).astype(np.uint64) << np.uint64(WORD_BITS)
        pair |= high.astype(np.uint64) << np.uint64(32) | low
        del low, high
        unique, at = np.unique(pair, return_inverse=True)
        sums = np.bincount(at, weights=counts, minlength=len(unique)).astype(np.int64)
        of = (unique >> np.uint64(WORD_BITS)).astype(np.int64)
        n = np.bincount(of, weights=sums, minlength=len(own)).astype(np.int64)
        kinds = np.bincount(of[sums > 0], minlength=len(own))
        answers = sums[at]
        out = []
        for i in range(rows):
            of_pairs, of_states = answers[pair_bounds[i] : pair_bounds[i + 1]], number[state_bounds[i] : state_bounds[i + 1]]
            out.append(
                {
                    "shard": shard,
                    "block": cells.column("block")[i].as_py(),
                    "counts": pack(of_pairs),
                    "state_counts": pack(n[of_states]),
                    "state_kinds": pack(kinds[of_states]),
                }
            )
        split = np.isin(own, heavy)
        word = (n > 0) & ~split & (own != START)
        parts = zip(own[split].view(np.int64).tolist(), n[split].tolist(), kinds[split].tolist(), strict=True)
        summary = [{"state": s, "n": c, "kinds": k} for s, c, k in parts]
        out.append({"shard": shard, "block": None, "known": int(word.sum()), "heavy": summary})
        return pa.Table.from_pylist(out, schema=TOLD_ARROW)

    return questions.groupBy("shard").applyInArrow(tell, TOLD)


@dataclass(frozen=True)
class Totals:
    """Training tokens (ends included), texts, distinct tokens, and the states spread over shards."""

    tokens: int
    texts: int
    distinct: int
    heavy: dict[int, tuple[int, int]]


def scored(bodies: DataFrame, answers: DataFrame, shards: int, totals: Totals) -> DataFrame:
    heavy = np.array(sorted(totals.heavy), dtype=np.int64).view(np.uint64)

    def score(body: pa.Table, cells: pa.Table) -> pa.Table:
        row = body.to_pylist()[0]
        b = block_of(row)
        states, tokens, at, doc, _ = b.pairs(shards, heavy)
        h, n_words = b.hashes(), len(b.vocabulary)
        by_shard = sorted(cells.to_pylist(), key=lambda r: r["shard"])
        counts = np.concatenate([unpack(r["counts"], np.int64) for r in by_shard])
        # A spread state begins a run in each shard; its totals come from the driver.
        begin = np.concatenate([runs_of_cell(states, low, high) for low, high in cell_bounds(by_shard)])
        state_n, state_kinds = np.zeros(n_words + 2, dtype=np.int64), np.zeros(n_words + 2, dtype=np.int64)
        state_n[states[begin]] = np.concatenate([unpack(r["state_counts"], np.int64) for r in by_shard])
        state_kinds[states[begin]] = np.concatenate([unpack(r["state_kinds"], np.int64) for r in by_shard])
        for i in np.flatnonzero(np.isin(h, heavy)):
            state_n[i], state_kinds[i] = totals.heavy[int(h[i].view(np.int64))]
        # Root arcs: every word of a text is also a state, so its count is at hand.
        seen = state_n.copy()
        seen[n_words], seen[n_words + 1] = 0, totals.texts
        root = (seen + 1.0) / (totals.tokens + totals.distinct + 1.0)
        # Arcs of the states, and failure arcs for pairs that training did not have.
        n, kinds = state_n[states], state_kinds[states]
        known_state = n > 0
        p = np.where(known_state, (counts + kinds * root[tokens]) / np.maximum(n + kinds, 1), root[tokens])
        doc_base = np.bincount(doc, weights=np.log10(root[tokens])[at], minlength=len(b.sizes))
        doc_score = np.bincount(doc, weights=np.log10(p)[at], minlength=len(b.sizes))
        known = np.bincount(doc, weights=(seen[tokens] > 0)[at], minlength=len(b.sizes)).astype(np.int64)
        return pa.table(
            {
                "doc_id": pa.array(b.doc_ids, pa.int64()),
                "held_out": pa.array(b.held_out),
                "n_tokens": pa.array(b.sizes + 1),
                "n_known": pa.array(known),
                "train_tokens": pa.array(np.full(len(b.sizes), totals.tokens)),
                "base_score": pa.array(doc_base),
                "score": pa.array(doc_score),
            }
        )

    def cell_bounds(cells: list[dict]) -> list[tuple[int, int]]:
        ends = np.cumsum([0] + [int.from_bytes(r["counts"][:8], "little") for r in cells])
        return list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))

    def runs_of_cell(states: np.ndarray, low: int, high: int) -> np.ndarray:
        return low + runs_of(states[low:high])

    both = bodies.groupBy("block").cogroup(answers.where("block is not null").groupBy("block"))
    return both.applyInArrow(score, SCORED)


def scores(docs: DataFrame, block_bytes: int = BLOCK_BYTES, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Score every text of ``docs`` (doc_id, text, held_out) by the model of those not held out.

    Tokens are runs of anything but ASCII white space, A-Z lower-cased, and one
    end; a null or empty text is just its end. ``base_score`` sums the root arcs,
    ``score`` the arcs taken, both log10. Words are told apart by 64-bit hashes
    (words after one state by 40 bits of them), so a collision is as unlikely as
    they are few. Null, repeated and equal ids are scored row by row; other
    columns are left out; an empty table gives an empty one. Without training
    texts all words have probability 1, as the one unknown word.

    A block and a shard exchange one row. Their numbers both grow with the input,
    so for many TB raise ``block_bytes`` and ``shard_tokens`` with the memory of
    the executors, or these rows get too small to pack well.
    """
    bounded_batches(docs.sparkSession)
    bodies = staged(blocks(docs.select("doc_id", "text", "held_out"), block_bytes), "lm-blocks")
    sums = bodies.agg(*[F.sum(c).alias(c) for c in ("n_tokens", "train_docs", "train_tokens")]).first()
    n_tokens, texts, train_tokens = (sums[c] or 0 for c in ("n_tokens", "train_docs", "train_tokens"))
    shares = bodies.select(F.explode("heavy").alias("heavy")).groupBy("heavy.state").agg(F.sum("heavy.n").alias("n"))
    heavy = [r["state"] for r in shares.where(F.col("n") * HEAVY > train_tokens).collect()]
    spread = np.array(sorted(heavy), dtype=np.int64).view(np.uint64)
    shards = max(1, -(-n_tokens // shard_tokens))
    answers = staged(told(asked(bodies, shards, spread), spread), "lm-counts")
    whole = answers.where("block is null")
    known = total(whole, F.sum("known"))
    parts = whole.select(F.explode("heavy").alias("h")).groupBy("h.state").agg(F.sum("h.n").alias("n"), F.sum("h.kinds").alias("k"))
    large = {r["state"]: (r["n"], r["k"]) for r in parts.collect()}
    start = int(START.view(np.int64))
    distinct = known + sum(n > 0 and s != start for s, (n, _) in large.items()) + (texts > 0)
    return scored(bodies, answers, shards, Totals(int(train_tokens), int(texts), int(distinct), large))
