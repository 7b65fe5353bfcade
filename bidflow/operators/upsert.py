"""Upsert of sources: insert, overwrite, or insert under a given id."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidflow.operators.ids import with_dense_ids
from bidflow.schemas import SOURCES

OVERWRITTEN = ("code", "name", "kind", "is_enabled", "description")


def _reject_repeats(rows: DataFrame, column: str, what: str) -> None:
    repeats = (
        rows.where(F.col(column).isNotNull()).groupBy(column).count().where("count > 1").orderBy(column).limit(5)
    )
    found = [r[column] for r in repeats.collect()]
    if found:
        raise ValueError(f"{what}: {found}")


def upsert_sources(stored: DataFrame, changes: DataFrame, now: datetime) -> DataFrame:
    """New version of the source table.

    ``changes`` has the columns of ``mapping.source_from_entity``. Id NULL: insert
    with the next ids in code order. Id stored: the five business columns are
    overwritten, both timestamps are kept. Id given but not stored: insert under
    that id. Two changes for one id, or two rows with one code, are an error.
    """
    _reject_repeats(changes, "id", "several changes for one source id")
    stamp = F.lit(now).cast("timestamp")
    keyed = changes.where(F.col("id").isNotNull()).select("id", *[F.col(c).alias(f"new_{c}") for c in OVERWRITTEN])
    given = F.col("new_code").isNotNull()
    merged = stored.join(keyed, "id", "full_outer").select(
        "id",
        *[F.when(given, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in OVERWRITTEN],
        F.coalesce("created_at", stamp).alias("created_at"),
        F.coalesce("updated_at", stamp).alias("updated_at"),
    )
    fresh = changes.where(F.col("id").isNull()).drop("id")
    if not fresh.isEmpty():
        last = merged.agg(F.max("id")).first()[0] or 0
        added = with_dense_ids(fresh, ["code"], after=last)
        merged = merged.unionByName(added.withColumns({"created_at": stamp, "updated_at": stamp}))
    _reject_repeats(merged, "code", "source code is not unique")
    return merged.select(*SOURCES.fieldNames())
