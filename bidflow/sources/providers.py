"""Raw-item providers: landed data of each source kind as PROVIDED rows.

A provider is a function returning a DataFrame; it stores nothing. Fetching
from networks happens elsewhere: these read what has landed.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidflow.functions.text import compact_time, iso_seconds, json_field
from bidflow.schemas import PROVIDED


# Made-up rows that one row is turned into at a time.
SLICE = 10_000


def provided(
    df: DataFrame,
    source_code: Column,
    external_id: Column,
    payload: Column,
    url: Column | None = None,
    received_at: Column | None = None,
    source_id: Column | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Project any landed table to the PROVIDED columns; source id 0 means unset.

    ``keep`` names columns to carry along, such as the place of a row in its file.
    """
    values = {
        "source_code": source_code,
        "source_id": F.lit(0) if source_id is None else source_id,
        "external_id": external_id,
        "payload": payload,
        "url": F.lit(None) if url is None else url,
        "created_at": received_at,
        "received_at": received_at,
    }
    return df.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in PROVIDED], *keep)


def html_pages(pages: DataFrame, source_code: Column, received_at: Column) -> DataFrame:
    """Landed pages (page_id, url, html): the whole page is the payload."""
    return provided(
        pages, source_code, F.concat(F.lit("page-"), F.col("page_id")), F.col("html"), F.col("url"), received_at
    )


def chat_messages(messages: DataFrame, source_code: Column, received_at: Column) -> DataFrame:
    """Landed messages (conv_id, turn, text): one item per message."""
    item = F.concat_ws("-", F.lit("msg"), "conv_id", "turn")
    return provided(messages, source_code, item, F.col("text"), None, received_at)


def api_records(records: DataFrame, source_code: Column, received_at: Column, id_field: str) -> DataFrame:
    """Landed API answers, one JSON text per row in ``value``; the id is a field of the JSON."""
    return provided(records, source_code, json_field(F.col("value"), id_field), F.col("value"), None, received_at)


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as plain text in ``value``, so that broken lines are kept as they came."""
    return spark.read.text(path)


def read_text_files(spark: SparkSession, path: str, source_code: str) -> DataFrame:
    """Whole text files; the file name is the external id, its time the received time."""
    files = spark.read.text(path, wholetext=True).select(
        "value",
        F.col("_metadata.file_name").alias("name"),
        F.col("_metadata.file_path").alias("place"),
        F.col("_metadata.file_modification_time").alias("landed_at"),
    )
    return provided(
        files, F.lit(source_code), F.col("name"), F.col("value"), F.col("place"), F.col("landed_at")
    )


# One reader of landed rows per source kind; a new kind only adds an entry.
READERS = {"html": html_pages, "telegram": chat_messages, "whatsapp": chat_messages, "api": api_records}


def stub_items(sources: DataFrame, now: datetime, copies: int = 1) -> DataFrame:
    """Made-up items: per source one row per second from ``now`` on, ``copies`` of them.

    With one copy this is the smoke-test provider; with many it is a load
    generator. ``now`` is an argument so that runs can be repeated.
    """
    # Slices of copies per source come first, so that a large load is many small rows for many tasks.
    slices = sources.select("id", "code", F.explode(F.sequence(F.lit(0), F.lit((copies - 1) // SLICE))).alias("slice"))
    if copies > SLICE:
        slices = slices.repartition("id", "slice")
    nth = F.explode(F.sequence(F.col("slice") * SLICE, F.least(F.col("slice") * SLICE + SLICE, F.lit(copies)) - 1))
    at = F.col("at")
    rows = slices.select("id", "code", nth.alias("nth")).select(
        "id", "code", (F.lit(now) + F.make_dt_interval(secs=F.col("nth").cast("double"))).alias("at")
    )
    text = F.concat(F.lit("Stub payload for source "), F.col("code"), F.lit(" at "), iso_seconds(at))
    item = F.concat_ws("-", F.lit("stub"), "code", compact_time(at))
    return provided(rows, F.col("code"), item, text, None, at, F.coalesce("id", F.lit(0)))
