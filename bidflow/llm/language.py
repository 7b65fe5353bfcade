"""Language identification by string kernels.

The kernel of two texts is the share of distinct byte n-grams (two to four
bytes, hashed to BINS bins) they have in common, over the geometric mean of
their numbers. Texts are mapped to their kernels with landmark texts (Nyström),
and kernel ridge regression tells each language from the rest. All kernels of a
batch are one matrix product.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidflow.llm.common import SLICE_BYTES, bounded_batches, extended, flat, pieces, unused

BINS = 1 << 14
GRAMS = (2, 3, 4)
LANDMARKS = 128
TRAIN_ROWS = 4000
MAX_LANGUAGES = 10_000
SCALE = 1 << 40
RIDGE = 1e-2
SHARPNESS = 4.0
UNKNOWN = "und"


def presence(texts: pa.Array) -> np.ndarray:
    """(texts, BINS) booleans: which hashed n-grams of the lower-cased bytes occur in each text."""
    data, offsets = flat(pc.utf8_lower(texts.fill_null("")))
    out = np.zeros((len(texts), BINS), dtype=bool)
    places = out.reshape(-1)
    # Slices overlap by the longest gram, so that a long text is seen whole in bounded memory.
    for low in range(0, max(len(data), 1), SLICE_BYTES):
        part = data[low : low + SLICE_BYTES + max(GRAMS) - 1].astype(np.uint32)
        row = np.searchsorted(offsets, np.arange(low, min(low + SLICE_BYTES, len(data))), "right") - 1
        gram = np.zeros(len(part), dtype=np.uint32)
        for n in range(1, max(GRAMS) + 1):
            if len(part) < n:
                break
            gram = (gram[: len(part) - n + 1] << np.uint32(8)) | part[n - 1 :]
            if n in GRAMS:
                m = min(len(gram), len(row))
                whole = np.arange(low, low + m) + n <= offsets[row[:m] + 1]
                salted = (gram[:m] + np.uint32(n)) * np.uint32(2654435761)
                places[(row[:m] * BINS + (salted >> np.uint32(32 - 14)))[whole]] = True
    return out


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    landmarks: np.ndarray  # (BINS, landmarks), columns over the root of their number
    weights: np.ndarray  # (landmarks, languages)

    def scores(self, found: np.ndarray) -> np.ndarray:
        return kernel(found, self.landmarks) @ self.weights


def kernel(found: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    roots = np.sqrt(np.maximum(found.sum(axis=1), 1)).astype(np.float32)
    return (found.astype(np.float32) @ landmarks) / roots[:, None]


def trained(found: np.ndarray, languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Model from n-gram presence of texts and their languages; landmarks go round the languages in turn."""
    names = sorted(set(languages))
    lang = np.array([names.index(x) for x in languages])
    turn = np.empty(len(lang), dtype=np.int64)
    for i in range(len(names)):
        turn[lang == i] = np.arange((lang == i).sum())
    chosen = np.lexsort((lang, turn))[: max(landmarks, len(names))]
    marks = found[chosen].astype(np.float32)
    marks = (marks / np.sqrt(np.maximum(marks.sum(axis=1, keepdims=True), 1))).T
    among = kernel(found[chosen], marks).astype(float)
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    keep = values > 1e-6 * max(values.max(), 1e-12)
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = kernel(found, marks).astype(float) @ root
    # Each language weighs the same, however many rows it has.
    weight = 1 / np.bincount(lang)[lang]
    wanted = np.where(lang[:, None] == np.arange(len(names)), 1.0, -1.0)
    left = phi.T @ (phi * weight[:, None]) + ridge * np.eye(phi.shape[1])
    return Model(tuple(names), marks, (root @ np.linalg.solve(left, phi.T @ (wanted * weight[:, None]))).astype(np.float32))


def sample(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """At most ``rows`` labelled texts, as many of each language, by a hash of id and text."""
    labelled = docs.select("doc_id", "lang", "text", F.xxhash64("doc_id", "text").alias("hash")).where(
        F.col("lang").isNotNull() & (F.length("text") > 0)
    )
    counts = labelled.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    each = max(2, rows // max(len(counts), 1))
    # Hashes are even: of a frequent language, those below this bound are some three times as many as wanted.
    bounds = {r["lang"]: min(SCALE, 3 * each * SCALE // r["count"] + SCALE // r["count"]) for r in counts}
    bound = F.element_at(F.from_json(F.lit(json.dumps(bounds)), "map<string,bigint>"), F.col("lang"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "hash"))
    chosen = labelled.select("lang", "hash", F.pmod("hash", F.lit(SCALE)).alias("draw")).where(F.col("draw") <= bound)
    chosen = chosen.withColumn("place", place).where(F.col("place") <= each).select("lang", "hash")
    # Equal rows share a hash and come in once.
    found = labelled.join(F.broadcast(chosen), ["lang", "hash"], "left_semi")
    return found.dropDuplicates(["lang", "hash"]).select("text", "lang")


def fit(docs: DataFrame, rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Model from ``docs`` (doc_id, text, lang); the driver sees n-gram bitmaps of at most ``rows`` texts only."""

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SLICE_BYTES):
            bits = np.packbits(presence(batch.column("text")), axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), pa.array([b.tobytes() for b in bits], pa.binary())], names=["lang", "bits"]
            )

    bounded_batches(docs.sparkSession)
    got = sample(docs, rows).mapInArrow(bitmaps, "lang string, bits binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["lang"], bytes(r["bits"])))
    found = np.unpackbits(np.array([np.frombuffer(r["bits"], dtype=np.uint8) for r in got]), axis=1).astype(bool)
    return trained(found, [r["lang"] for r in got], landmarks, ridge)


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with lang_pred and score in place of ``text``.

    Null texts and texts without a letter are ``und`` with score 0, and so is
    everything if no labelled row was there to learn from. Every row is kept;
    other columns pass through, but those named lang_pred or score are replaced.
    """
    rest = docs.drop("text", "lang_pred", "score")
    bounded_batches(docs.sparkSession)
    name = unused(rest, "text")
    rows = docs.select(*rest.columns, F.col("text").alias(name))
    schema = extended(rest.schema, lang_pred="string", score="double")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(r"\p{L}")
        for batch in pieces(batches, name, SLICE_BYTES // 2):
            texts = batch.column(batch.num_columns - 1)
            readable = np.array([t is not None and letter.search(t) is not None for t in texts.to_pylist()], dtype=bool)
            names = np.full(len(texts), UNKNOWN, dtype=object)
            score = np.zeros(len(texts))
            # Few texts at a time: their bitmaps take BINS bytes each.
            for start in range(0, len(texts) if model else 0, 256):
                f = model.scores(presence(texts.slice(start, 256))).astype(float) * SHARPNESS
                e = np.exp(f - f.max(axis=1, keepdims=True))
                best = f.argmax(axis=1)
                names[start : start + 256] = np.array(model.languages, dtype=object)[best]
                score[start : start + 256] = e[np.arange(len(best)), best] / e.sum(axis=1)
            names[~readable], score[~readable] = UNKNOWN, 0.0
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(names.tolist(), pa.string()), pa.array(score)], names=schema.names
            )

    return rows.mapInArrow(predict, schema)
