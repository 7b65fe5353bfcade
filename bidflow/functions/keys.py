"""Content hashes and dedup keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidflow.functions.text import squeeze


def content_hash(payload: Column) -> Column:
    """64 hex digits over the whole payload."""
    return F.sha2(payload, 256)


def normalized(df: DataFrame, field: str) -> Column:
    """A field as it takes part in a key: text is lower-cased with blanks collapsed."""
    c = F.col(field)
    return F.lower(squeeze(c)) if isinstance(df.schema[field].dataType, T.StringType) else c


def dedup_key(df: DataFrame, fields: Sequence[str], null_policy: str = "skip", window_days: int = 0) -> Column:
    """64-digit key over the named fields.

    Field names are part of the hashed text, so no separator can make two rows
    collide. ``skip`` gives NULL when any field is NULL, ``equal`` lets NULL match
    NULL. ``window_days`` > 0 also keys on the calendar window of ``created_at``.
    """
    parts = [normalized(df, f).alias(f) for f in fields]
    if window_days > 0:
        day = F.unix_date(F.col("created_at").cast("date"))
        parts.append(F.floor(day / F.lit(window_days)).alias("window"))
    key = F.sha2(F.to_json(F.struct(*parts)), 256)
    if null_policy == "equal":
        return key
    if null_policy != "skip":
        raise ValueError(f"null_policy must be 'skip' or 'equal', not {null_policy!r}")
    for field in fields:
        key = F.when(F.col(field).isNotNull(), key)
    return key


def item_key() -> Column:
    """Source, external id and content of a raw item as one key; NULL equals NULL.

    Field names keep NULL apart from every text.
    """
    content = content_hash(F.col("payload")).alias("hash")
    return F.sha2(F.to_json(F.struct("source_id", "external_id", content)), 256)
