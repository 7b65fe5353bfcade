"""Toxic documents by a chain of linear classifiers.

Features are words and beginnings of words that labelled toxic documents have
more often than others, each once for occurring and once for occurring again.
Categories are predicted one after the other: marked words, many of them, and
toxic as a whole. The later models get the earlier probabilities as inputs,
predicted out of fold when they are trained.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidflow.llm.common import bounded_batches, extended, flat, grouped, pieces, word_hashes
from bidflow.shared import staged

PREFIXES = (4, 5, 6, 7)
TRAIN_ROWS = 12_000
FEATURES = 256
SCALE = 1 << 40
LEAST_DOCS = 5
FOLDS = 5
RIDGE = 1.0
THRESHOLD = 0.5
CATEGORIES = ("marked", "repeated", "toxic")
MANY = 3

# Letters only: other ASCII bytes separate words.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[b for b in range(128) if not chr(b).isalpha()]] = 32


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature hash, how often) of all words and beginnings of words, each pair once."""
    data, offsets = flat(texts)
    words, counts, starts = word_hashes(_PLAIN[data], offsets, PREFIXES)
    doc = np.tile(grouped(counts), 1 + len(PREFIXES))
    h = np.concatenate([words, *starts])
    doc, h = doc[h != 0], h[h != 0]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


@dataclass(frozen=True)
class Chain:
    """Sorted feature hashes; column of each when it occurs, and when it occurs again (-1: none); weights by category."""

    hashes: np.ndarray
    once: np.ndarray
    again: np.ndarray
    weights: tuple[np.ndarray, ...]  # over features, constant, earlier probabilities

    def columns(self, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indices into h, columns) of all features set."""
        at = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        hit = np.flatnonzero(self.hashes[at] == h) if len(self.hashes) else np.zeros(0, dtype=np.int64)
        first, second = self.once[at[hit]], np.where(n[hit] > 1, self.again[at[hit]], -1)
        rows, cols = np.concatenate([hit, hit]), np.concatenate([first, second])
        return rows[cols >= 0], cols[cols >= 0]

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        doc, h, n = features(texts)
        rows, cols = self.columns(h, n)
        width = int(max(self.once.max(initial=-1), self.again.max(initial=-1))) + 1
        x = np.zeros((len(texts), width))
        x[doc[rows], cols] = 1
        return chained(x, self.weights)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def with_constant(x: np.ndarray, earlier: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([x, np.ones(len(x)), *earlier])


def chained(x: np.ndarray, weights: tuple[np.ndarray, ...]) -> np.ndarray:
    """(rows, categories): each probability is an input of the ones after it."""
    out: list[np.ndarray] = []
    for w in weights:
        out.append(sigmoid(with_constant(x, out) @ w))
    return np.column_stack(out) if out else np.zeros((len(x), 0))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 12) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        slope = x.T @ (p - y) + ridge * w
        bend = (x.T * np.maximum(p * (1 - p), 1e-6)) @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


def trained_chain(x: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Weights of each category; ``labels`` has a column for each, ``folds`` the fold of each row."""
    weights, earlier = [], []
    for k in range(labels.shape[1]):
        own, y = with_constant(x, earlier), labels[:, k].astype(float)
        weights.append(logistic(own, y))
        if k + 1 < labels.shape[1]:
            out = np.zeros(len(y))
            for fold in np.unique(folds):
                rest = folds != fold
                out[~rest] = sigmoid(own[~rest] @ logistic(own[rest], y[rest])) if rest.any() else 0.5
            earlier.append(out)
    return tuple(weights)


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, toxic, hash) of at most ``rows`` labelled documents, by a hash of their ids."""
    clean = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    # Hashes are even: some three times as many rows as wanted pass this bound, so that the sort sees few.
    n = max(clean.count(), 1)
    few = clean.withColumn("hash", F.xxhash64("doc_id")).where(F.pmod("hash", F.lit(SCALE)) <= (3 * rows + 1) * SCALE // n)
    chosen = (
        few.groupBy("doc_id", "hash")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.pmod("hash", F.lit(SCALE)), "hash")
        .limit(rows)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return texts.dropDuplicates(["doc_id"]).select("text", "toxic", "hash")


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, width: int = FEATURES) -> Chain:
    """The chain from labelled documents.

    Document frequencies of features are counted on the executors; the driver
    sees the FEATURES best and which of them each of at most ``rows`` documents
    has. Without rows of both labels the chain calls nothing toxic.
    """
    bounded_batches(docs.sparkSession)
    chosen = staged(sample(docs, labels, rows), "toxicity-sample")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            doc, h, n = features(batch.column("text"))
            keys, at = np.unique(h, return_inverse=True)
            columns = [pa.array(keys.view(np.int64))]
            for is_toxic in (1, 0):
                for least in (1, 2):
                    hit = (toxic[doc] == is_toxic) & (n >= least)
                    columns.append(pa.array(np.bincount(at[hit], minlength=len(keys))))
            yield pa.RecordBatch.from_arrays(columns, names=["h", "t1", "t2", "c1", "c2"])

    sizes = {r["toxic"]: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        none = np.zeros(0, dtype=np.int64)
        return Chain(none.view(np.uint64), none, none, tuple(np.append(-50.0, np.zeros(k)) for k in range(len(CATEGORIES))))
    counted = chosen.mapInArrow(frequencies, "h bigint, t1 bigint, t2 bigint, c1 bigint, c2 bigint")
    total = counted.groupBy("h").agg(*[F.sum(c).alias(c) for c in ("t1", "t2", "c1", "c2")])
    levels = F.explode(
        F.array(*[F.struct(F.lit(k).alias("level"), F.col(f"t{k}").alias("t"), F.col(f"c{k}").alias("c")) for k in (1, 2)])
    )
    share = (F.col("t") + F.col("c")) / float(n_toxic + n_clean)
    gain = (F.col("t") / n_toxic - F.col("c") / n_clean) / F.sqrt(share * (1 - share) + 1e-9)
    best = (
        total.where(F.col("t1") >= LEAST_DOCS)
        .select("h", levels.alias("f"))
        .select("h", "f.*")
        .where(F.col("t") >= LEAST_DOCS)
        .withColumn("gain", gain)
        .orderBy(F.desc("gain"), "h", "level")
        .limit(width)
        .collect()
    )
    hashes = np.unique(np.array([r["h"] for r in best], dtype=np.int64).view(np.uint64))
    once, again = np.full(len(hashes), -1), np.full(len(hashes), -1)
    for column, r in enumerate(best):
        at = int(np.searchsorted(hashes, np.int64(r["h"]).astype(np.uint64)))
        (once if r["level"] == 1 else again)[at] = column
    picked = Chain(hashes, once, again, ())

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            doc, h, n = features(batch.column("text"))
            rows, cols = picked.columns(h, n)
            set_of = [[] for _ in range(batch.num_rows)]
            for d, c in zip(doc[rows].tolist(), cols.tolist(), strict=True):
                set_of[d].append(c)
            yield pa.RecordBatch.from_arrays(
                [batch.column("hash"), batch.column("toxic").cast(pa.int32()), pa.array(set_of, pa.list_(pa.int32()))],
                names=["hash", "toxic", "columns"],
            )

    got = chosen.mapInArrow(rows_of, "hash bigint, toxic int, columns array<int>").collect()
    got.sort(key=lambda r: r["hash"])
    x = np.zeros((len(got), len(best)))
    for i, r in enumerate(got):
        x[i, r["columns"]] = 1
    y = np.array([r["toxic"] for r in got])
    hits = x.sum(axis=1)
    labels_of = np.column_stack([(y == 1) & (hits >= 1), (y == 1) & (hits >= MANY), y == 1])
    folds = np.arange(len(got)) % FOLDS
    return Chain(hashes, once, again, trained_chain(x, labels_of, folds))


def scored(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the probability of each category (p_marked, p_repeated, p_toxic) and the verdict ``toxic``.

    A null or empty text has no features and gets the probabilities of such a
    text. Every row is kept; columns with the names of the results are replaced.
    """
    own = [f"p_{c}" for c in CATEGORIES] + ["toxic"]
    bounded_batches(docs.sparkSession)
    rest = docs.drop(*own)
    schema = extended(rest.schema, **dict.fromkeys(own[:-1], "double"), toxic="boolean")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            p = chain.probabilities(batch.column("text"))
            columns = [*batch.columns, *[pa.array(p[:, k]) for k in range(len(CATEGORIES))], pa.array(p[:, -1] >= threshold)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rest.mapInArrow(predict, schema)
