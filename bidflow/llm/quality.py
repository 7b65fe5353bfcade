"""Text quality by a regularised quadratic discriminant.

Each class is a normal distribution of transformed document statistics. Class
covariances are shrunk towards the diagonal of the pooled one; a score is the
difference of two Mahalanobis log densities, by Cholesky factors computed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidflow.llm.common import bounded_batches, extended, flat, grouped, pieces, unused, word_hashes

SHRINKAGE = 0.1
FLOOR = 1e-4
STATISTICS = (
    "words word_bytes capitals digits stops symbols other_letters distinct_words line_words shouted"
).split()
N = len(STATISTICS)

_KIND = np.zeros(256, dtype=np.uint8)  # 0: symbols and control characters
for _kind, _bytes in enumerate((b"\t\n\x0b\x0c\r ", range(97, 123), range(65, 91), range(48, 58), b".,;:'\"-()?", range(128, 256)), 1):
    _KIND[list(_bytes)] = _kind


def statistics(texts: pa.Array) -> np.ndarray:
    """(texts, N) transformed statistics; a null or empty text has zeros."""
    data, offsets = flat(texts)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)
    kinds = np.bincount(row * 7 + _KIND[data], minlength=7 * len(sizes)).reshape(-1, 7)
    lines = 1 + np.bincount(row[data == 10], minlength=len(sizes))
    hashes, words, _ = word_hashes(data, offsets)
    doc = grouped(words)
    order = np.lexsort((hashes, doc))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (np.diff(hashes[order]) != 0) | (np.diff(doc[order]) != 0)
    distinct = np.bincount(doc[order][new], minlength=len(sizes))
    marks = np.bincount(row[data == 33], minlength=len(sizes))
    some, n = np.maximum(words, 1), np.maximum(sizes - kinds[:, 1], 1)
    return np.column_stack(
        [
            np.log1p(words),
            np.log1p((sizes - kinds[:, 1]) / some),
            np.sqrt(kinds[:, 3] / n),
            np.sqrt(kinds[:, 4] / n),
            np.sqrt(kinds[:, 5] / n),
            np.sqrt(kinds[:, 0] / n),
            np.sqrt(kinds[:, 6] / n),
            distinct / some,
            np.log1p(words / lines),
            np.sqrt(marks / n),
        ]
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the array ``x`` in place of ``text``."""
    rest = docs.drop("text", "x")
    bounded_batches(docs.sparkSession)
    name = unused(rest, "text")
    rows = docs.select(*rest.columns, F.col("text").alias(name))
    schema = extended(rest.schema, x="array<double>")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, name):
            x = statistics(batch.column(batch.num_columns - 1))
            flat_x = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * N, x.reshape(-1))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, flat_x], names=schema.names)

    return rows.mapInArrow(measured, schema)


@dataclass(frozen=True)
class Model:
    """Of class 0 and 1: log prior, mean, inverse Cholesky factor, log of the factor's determinant."""

    log_priors: tuple[float, float]
    means: tuple[np.ndarray, np.ndarray]
    factors: tuple[np.ndarray, np.ndarray]
    log_dets: tuple[float, float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        density = [
            p - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) - d
            for p, m, f, d in zip(self.log_priors, self.means, self.factors, self.log_dets, strict=True)
        ]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def model_of(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE) -> Model | float:
    """From n, sums and sums of products of each class; a single class gives its constant score, none 0.5."""
    there = sorted(k for k, (n, _, _) in moments.items() if n > 0)
    if len(there) < 2:
        return float(there[0]) if there else 0.5
    total = sum(moments[k][0] for k in there)
    means = {k: moments[k][1] / moments[k][0] for k in there}
    spread = {k: moments[k][2] / moments[k][0] - np.outer(means[k], means[k]) for k in there}
    pooled = sum(spread[k] * moments[k][0] for k in there) / total
    target = np.diag(np.maximum(np.diag(pooled), 0) + FLOOR)
    roots = [np.linalg.cholesky((1 - shrinkage) * spread[k] + shrinkage * target + FLOOR * np.eye(N)) for k in there]
    return Model(
        tuple(float(np.log(moments[k][0] / total)) for k in there),
        tuple(means[k] for k in there),
        tuple(np.linalg.inv(r) for r in roots),
        tuple(float(np.log(np.diag(r)).sum()) for r in roots),
    )


def fit(labelled: DataFrame, shrinkage: float = SHRINKAGE) -> Model | float:
    """Model from ``labelled`` (x, label); all rows count, through one row of moments for each class."""
    sums = [F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(N)]
    products = [
        F.sum(F.get("x", F.lit(i)) * F.get("x", F.lit(j))).alias(f"p{i}_{j}") for i in range(N) for j in range(i, N)
    ]
    rows = labelled.where(F.col("label").isin(0, 1)).groupBy("label").agg(F.count("*").alias("n"), *sums, *products)
    moments = {}
    for r in rows.collect():
        p = np.zeros((N, N))
        for i in range(N):
            for j in range(i, N):
                p[i, j] = p[j, i] = r[f"p{i}_{j}"]
        moments[int(r["label"])] = (float(r["n"]), np.array([r[f"s{i}"] for i in range(N)]), p)
    return model_of(moments, shrinkage)


def score(x: Column, model: Model | float) -> Column:
    """Probability of class 1 of the statistics ``x``."""
    if not isinstance(model, Model):
        return F.lit(float(model))

    @F.pandas_udf("double")
    def of(column: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.stack(column.to_numpy())) if len(column) else np.zeros(0))

    return of(x)
