"""What the text operators share: reading, splits, blocks of texts, word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 1 << 20
MASK = (1 << 64) - 1

# Word hashes: a polynomial over a table of random letters, modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
_RNG = np.random.default_rng(20251203)
LETTERS = _RNG.integers(1, 1 << 63, size=256, dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of few MB for the Python tasks of this session, if it still has Spark's much larger default."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, "8m")


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text modulo ``divisor``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def extended(schema: T.StructType, **kinds: str) -> T.StructType:
    """The schema with more columns, given by name and SQL type."""
    more = [T.StructField(name, T._parse_datatype_string(kind)) for name, kind in kinds.items()]
    return T.StructType([*schema.fields, *more])


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def total(df: DataFrame, expression: Column, default=0):
    """One number over all rows."""
    value = df.agg(expression).first()[0]
    return default if value is None else value


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of about ``limit`` bytes of ``column``, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(offsets_of(batch.column(column)))
        if len(sizes) == 0 or sizes.sum() <= limit:
            yield batch
            continue
        ends = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def offsets_of(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    raw = np.frombuffer(texts.buffers()[1], dtype=kind) if texts.buffers()[1] else np.zeros(1, dtype=kind)
    return raw[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts in a row, offsets); a null text is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = offsets_of(texts)
    data = texts.buffers()[2]
    if data is None or not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of 64-bit hashes spread evenly."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse, as far as asked for."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            with np.errstate(over="ignore"):
                for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                    steps = np.full(n, base & MASK, dtype=np.uint64)
                    steps[0] = 1
                    setattr(cls, name, np.cumprod(steps))
        return cls.up, cls.down


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words per text); words are runs of anything but ASCII white space, never over two texts."""
    inside = ~WHITE[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[heads] = inside[heads]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[tails] = inside[tails]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...] = (), lower: bool = True
) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(64-bit hash of every word, words per text, hashes of its first k bytes for each k).

    A-Z are lower-cased. A prefix hash is 0 where the word is no longer than it.
    Works in slices that end between words, so memory follows the longest word.
    """
    starts, ends, counts = word_bounds(data, offsets)
    out = np.empty(len(starts), dtype=np.uint64)
    more = [np.zeros(len(starts), dtype=np.uint64) for _ in prefixes]
    first = 0
    with np.errstate(over="ignore"):
        while first < len(starts):
            low = starts[first]
            last = max(first + 1, int(np.searchsorted(ends, low + SLICE_BYTES, "right")))
            part = data[low : ends[last - 1]]
            up, down = Powers.upto(len(part) + 1)
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(LETTERS[LOWER[part] if lower else part] * up[: len(part)], out=sums[1:])
            s, e = starts[first:last] - low, ends[first:last] - low
            out[first:last] = mixed((sums[e] - sums[s]) * down[s])
            for k, to in zip(prefixes, more, strict=True):
                cut = np.minimum(s + k, e)
                h = mixed(((sums[cut] - sums[s]) * down[s]) ^ np.uint64(k))
                to[first:last] = np.where(e - s > k, h, np.uint64(0))
            first = last
    return out, counts, more


def grouped(sizes: np.ndarray) -> np.ndarray:
    """The number of the text of each word, from words per text."""
    return np.repeat(np.arange(len(sizes)), sizes)
