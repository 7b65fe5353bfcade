"""Row mappings between stored tables and the domain view, and bid building."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidflow.functions.text import bid_title, or_empty
from bidflow.schemas import BIDS, PRICE, WEIGHT


def source_to_entity(sources: DataFrame) -> DataFrame:
    return sources.select(
        "id", "code", "name", "kind",
        F.col("is_enabled").alias("is_active"),
        or_empty(F.col("description")).alias("description"),
    )


def source_from_entity(entities: DataFrame) -> DataFrame:
    """The columns a source update may overwrite; timestamps are not among them."""
    return entities.select(
        "id", "code", "name", "kind", F.col("is_active").alias("is_enabled"), "description"
    )


def raw_to_entity(raw_items: DataFrame) -> DataFrame:
    return raw_items.select(
        "id", "source_id", "external_id", "payload", "url", "created_at",
        F.col("fetched_at").alias("received_at"),
    )


def raw_from_entity(entities: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Stored form of new, numbered raw items, with the columns of ``keep`` beside it."""
    nothing = F.lit(None).cast("string")
    return entities.select(
        "id",
        "source_id", "external_id", "url",
        F.col("received_at").alias("fetched_at"),
        "payload",
        F.lit("new").alias("status"),
        nothing.alias("error_message"),
        nothing.alias("hash"),
        "created_at",
        *keep,
    )


def bid_to_entity(bids: DataFrame) -> DataFrame:
    """Domain view of stored bids; the weight unit plays no part."""
    return bids.select(
        "id", "source_id", "raw_item_id", "external_id", "title",
        or_empty(F.col("description")).alias("description"),
        "cargo_type", "transport_type",
        F.col("load_location").alias("load_point"),
        F.col("unload_location").alias("unload_point"),
        F.col("weight_value").cast("double").alias("weight_tons"),
        F.col("price_value").cast("double").alias("price"),
        F.col("price_currency").alias("currency"),
        F.col("contact_phone").alias("contact"),
        "url", "published_at", "created_at",
    )


def bid_from_entity(entities: DataFrame) -> DataFrame:
    """Stored form of new bids. Decimals round half up; what a domain bid does
    not carry (regions, contact name and mail, received time, dedup key) is NULL."""
    filled = {
        "load_location": F.col("load_point"),
        "unload_location": F.col("unload_point"),
        "weight_value": F.col("weight_tons").cast(WEIGHT),
        "weight_unit": F.when(F.col("weight_tons").isNotNull(), F.lit("t")),
        "price_value": F.col("price").cast(PRICE),
        "price_currency": F.col("currency"),
        "contact_phone": F.col("contact"),
        "is_duplicate": F.lit(False),
        "updated_at": F.col("created_at"),
    }
    columns = []
    for field in BIDS:
        if field.name in filled:
            value = filled[field.name]
        elif field.name in entities.columns:
            value = F.col(field.name)
        else:
            value = F.lit(None)
        columns.append(value.cast(field.dataType).alias(field.name))
    return entities.select(*columns)


def backfill_source(provided: DataFrame, sources: DataFrame) -> DataFrame:
    """Attach source attributes and fill the source id where it is 0.

    An id that is already set stays, even if it differs from the source's own.
    Whether the sources travel by broadcast is Catalyst's choice from their size.
    """
    src = sources.select(
        F.col("id").alias("_sid"),
        F.col("code").alias("source_code"),
        F.col("name").alias("source_name"),
    )
    own = F.when(F.col("source_id") == 0, F.coalesce(F.col("_sid"), F.lit(0)))
    return (
        provided.join(src, "source_code", "inner")
        .withColumn("source_id", own.otherwise(F.col("source_id")))
        .drop("_sid")
    )


def build_bids(raw_entities: DataFrame, now: datetime) -> DataFrame:
    """One plain domain bid per raw item.

    Needs the raw columns plus ``source_code`` and ``source_name``; everything a
    raw item does not know keeps its default, and the bid is created ``now``.
    """
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    return raw_entities.select(
        "source_id",
        F.col("id").alias("raw_item_id"),
        "external_id",
        bid_title(F.col("source_name"), F.col("source_code"), F.col("external_id"), F.col("id")).alias("title"),
        F.col("payload").alias("description"),
        text.alias("cargo_type"),
        text.alias("transport_type"),
        text.alias("load_point"),
        text.alias("unload_point"),
        number.alias("weight_tons"),
        number.alias("price"),
        text.alias("currency"),
        text.alias("contact"),
        "url",
        F.lit(None).cast("timestamp").alias("published_at"),
        F.lit(now).cast("timestamp").alias("created_at"),
    )
