"""Lempel-Ziv phrase fingerprints.

A text is parsed into phrases, each a phrase seen before and one byte more. Its
fingerprint holds the KEEP smallest hashes of its phrases; the likeness of two
texts is the share of common hashes among the KEEP smallest of both together,
which estimates the Jaccard similarity of their phrase sets.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidflow.llm.common import BASE, MASK, bounded_batches, mixed, pieces

KEEP = 128
# A dictionary of so many phrases is emptied, as compressors do, so that memory stays bounded.
PHRASES = 1 << 22
BLOCKS_PER_PARTITION = 8
SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)


class Parse:
    """Phrases of the bytes fed so far: ``next`` leads from (phrase, byte) to a phrase, ``hashes`` has their hashes."""

    def __init__(self) -> None:
        self.next: dict[int, int] = {}
        self.hashes = [0]
        self.at = 0
        self.least = np.zeros(0, dtype=np.uint32)

    def copy(self) -> Parse:
        other = Parse()
        other.next, other.hashes = self.next.copy(), self.hashes.copy()
        other.at, other.least = self.at, self.least
        return other

    def feed(self, data: bytes) -> Parse:
        for start in range(0, len(data), PHRASES):
            self._feed(data[start : start + PHRASES])
            if len(self.hashes) > PHRASES:
                self.least, self.next, self.hashes, self.at = self.signature(), {}, [0], 0
        return self

    def _feed(self, data: bytes) -> None:
        step, hashes, at = self.next, self.hashes, self.at
        find = step.get
        for byte in data:
            key = at << 8 | byte
            found = find(key)
            if found is None:
                step[key] = len(hashes)
                hashes.append((hashes[at] * BASE + byte + 1) & MASK)
                at = 0
            else:
                at = found
        self.at = at

    def signature(self) -> np.ndarray:
        """The smallest hashes, sorted; all of them if there are fewer."""
        h = (mixed(np.array(self.hashes[1:], dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
        if len(h) > 2 * KEEP:
            h = np.partition(h, 2 * KEEP)[: 2 * KEEP]
        return np.unique(np.concatenate([self.least, h]))[:KEEP]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity; two texts without phrases are alike."""
    both = np.union1d(a, b)[:KEEP]
    if not len(both):
        return 1.0
    return float(np.isin(both, a, assume_unique=True) @ np.isin(both, b, assume_unique=True).astype(np.int64)) / len(both)


def written(signature: np.ndarray) -> str:
    return base64.b64encode(signature.astype("<u4").tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), dtype="<u4")


def edited(text: str, following: str) -> tuple[str, str]:
    """(what stays, what takes the place of the last half of the code points)."""
    half = len(text) // 2
    return text[: len(text) - half], following[:half]


def compared(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness to each other and to the next text.

    Documents are ordered by doc_id (null last), equal ids by a hash of the
    text; the last one is followed by the first. A null text counts as empty; an
    empty text has an empty fingerprint, which is like itself only. Equal rows
    follow one another like any others. A table of one row follows itself. Extra
    columns are left out; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    probs = [i / (n * BLOCKS_PER_PARTITION) for i in range(1, n * BLOCKS_PER_PARTITION)]
    bounds = np.unique(np.array(rows.where("doc_id is not null").approxQuantile("doc_id", probs, 0.0005), dtype=np.float64))

    @F.pandas_udf("int")
    def block_of(ids: pd.Series) -> pd.Series:
        at = np.searchsorted(bounds, ids.to_numpy(dtype=np.float64, na_value=np.nan), "right")
        return pd.Series(np.where(ids.isna(), len(bounds) + 1, at).astype(np.int32))

    keyed = rows.withColumns({"block": block_of("doc_id"), "hash": F.xxhash64("text")})
    first = F.min(F.struct("doc_id", "hash")).alias("head")
    heads = keyed.groupBy("block").agg(first).select("block", "head.*").orderBy("block").collect()
    # The first row of a block also goes to the end of the one before.
    before = [(h["doc_id"], h["hash"], heads[i - 1]["block"]) for i, h in enumerate(heads)]
    head = F.broadcast(spark.createDataFrame(before, "head_id bigint, head_hash bigint, previous int"))
    matched = keyed.join(head, keyed["doc_id"].eqNullSafe(head["head_id"]) & (keyed["hash"] == head["head_hash"]), "left")
    own = F.struct("block", F.lit(False).alias("peek"))
    shown = F.struct(F.col("previous").alias("block"), F.lit(True).alias("peek"))
    places = F.when(F.col("previous").isNull(), F.array(own)).otherwise(F.array(own, shown))
    laid = (
        matched.select("doc_id", "text", "hash", F.explode(places).alias("place"))
        .select("doc_id", "text", "hash", "place.*")
        .repartition(n, "block")
        .sortWithinPartitions("block", "peek", F.asc_nulls_last("doc_id"), "hash")
        .select("block", "peek", "doc_id", "text")
    )

    def fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(doc_id, text: str, start: str, before_half: Parse, whole: np.ndarray, after: str, following: np.ndarray):
            stays, comes = start, after[: len(text) - len(start)]
            other = before_half.feed(comes.encode()).signature()
            sha = hashlib.sha256((stays + comes).encode()).hexdigest()
            return (
                doc_id, len(text), sha, written(whole), written(other), likeness(whole, other), likeness(whole, following),
            )

        def parsed(text: str) -> tuple[str, Parse, np.ndarray]:
            start = text[: len(text) - len(text) // 2]
            half = Parse().feed(start.encode())
            return start, half, half.copy().feed(text[len(start) :].encode()).signature()

        last = None
        for batch in pieces(batches, "text"):
            out = []
            for block, peek, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if last is not None and last[0] != block:
                    last = None
                if peek and last is None:
                    continue
                start, half, whole = parsed(text)
                if last is not None:
                    out.append(row(*last[1:], text, whole))
                last = None if peek else (block, doc_id, text, start, half, whole)
            if out:
                names = SCHEMA_NAMES
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), SCHEMA_TYPES, strict=True)], names=names
                )

    return laid.mapInArrow(fingerprinted, SCHEMA)


SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(",")]
SCHEMA_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
