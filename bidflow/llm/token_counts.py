"""Token counts of whole texts by a public tokenizer; only lengths leave the tasks.

Texts are cut at boundaries no token crosses, the distinct pieces of a task are
encoded once, in calls of about equal bytes, and a text's count is the sum over
its pieces.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidflow.llm.common import bounded_batches, extended, offsets_of, pieces, unused

CALL_BYTES = 1 << 18
MEMO_PIECES = 500_000
# A space between two ASCII letters: byte-level vocabularies put it at the head of the next word.
BETWEEN_LETTERS = r"(?<=[A-Za-z])(?= [A-Za-z])"


def drops_white(definition: dict) -> bool:
    """Whether white space only ever separates tokens: it is neither kept nor part of a special string."""
    steps = definition.get("pre_tokenizer") or {}
    first = (steps.get("pretokenizers") or [steps])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    special = definition.get("added_tokens") or []
    return (
        first.get("type") == "Split"
        and first.get("behavior") == "Removed"
        and bool(first.get("invert"))
        and "\\s" not in pattern.replace("[^\\s", "")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in special)
    )


def splitter(path: str, definition: dict | None) -> Callable[[str], Iterable]:
    """Cuts a text at safe boundaries; sentence pieces are merged over spaces, so such texts stay whole."""
    if definition is None:
        return lambda text: [text]
    if drops_white(definition):
        # Bytes are split at ASCII white space alone, which every pattern counts as such.
        return lambda text: text.encode().split()
    between = re.compile(BETWEEN_LETTERS)
    return between.split


def token_counts(docs: DataFrame, path: str, limit: int = 2048, column: str = "text") -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (more than ``limit`` tokens) in place of ``column``.

    ``path`` names a vocabulary: ``.json`` for tokenizers, ``.model`` for
    sentencepiece. It is read by the driver and travels with the task. No begin,
    end or padding is added and nothing is cut off. A null or empty text has no
    bytes and no tokens. All other columns pass through, but those with the
    names of the results are replaced.
    """
    own = ("n_bytes", "n_tokens", "over_limit")
    rest = docs.drop(column, *own)
    bounded_batches(docs.sparkSession)
    name = unused(rest, "text")
    rows = docs.select(*rest.columns, F.col(column).alias(name))
    schema = extended(rest.schema, n_bytes="bigint", n_tokens="bigint", over_limit="boolean")
    raw = Path(path).read_bytes()
    definition = json.loads(raw) if path.endswith(".json") else None

    def encoder() -> Callable[[list], list[int]]:
        if definition is None:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=raw)
            return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_str(raw.decode())
        model.no_truncation()
        model.no_padding()
        return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, cut, memo = encoder(), splitter(path, definition), {}
        for batch in pieces(batches, name):
            texts = batch.column(batch.num_columns - 1).fill_null("")
            parts = [list(cut(t)) for t in texts.to_pylist()]
            new = list({p for part in parts for p in part}.difference(memo))
            if len(memo) + len(new) > MEMO_PIECES:
                memo = {}
                new = list({p for part in parts for p in part})
            start = size = 0
            for stop, p in enumerate(new, 1):
                size += len(p)
                if size >= CALL_BYTES or stop == len(new):
                    some = new[start:stop]
                    memo.update(zip(some, lengths([x.decode() if isinstance(x, bytes) else x for x in some]), strict=True))
                    start, size = stop, 0
            tokens = np.array([sum(map(memo.__getitem__, part)) for part in parts], dtype=np.int64)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns += [pa.array(np.diff(offsets_of(texts))), pa.array(tokens), pa.array(tokens > limit)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(counted, schema)
