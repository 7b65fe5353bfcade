"""Lookups by id, by code and since a moment; search pages."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidflow.schemas import BID_FIELDS


def by_id(table: DataFrame, row_id: int) -> DataFrame:
    return table.where(F.col("id") == row_id)


def by_ids(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is asked for; unknown ids give nothing.

    Ids asked for many times are folded before the shuffle.
    """
    return table.join(ids.select("id").distinct(), "id", "left_semi")


def source_by_code(sources: DataFrame, code: str) -> DataFrame:
    """Exact, case-sensitive match."""
    return sources.where(F.col("code") == code)


def sources_by_codes(sources: DataFrame, codes: DataFrame) -> DataFrame:
    return sources.join(codes.select("code").distinct(), "code", "left_semi")


def all_sources(sources: DataFrame) -> DataFrame:
    return sources.orderBy("id")


def active_sources(sources: DataFrame) -> DataFrame:
    return sources.where("is_enabled").orderBy("id")


def _part(moment: Column, period: str) -> Column:
    """First day of the partition that holds ``moment``; partitions span a day, a month or a year."""
    return F.to_date(F.date_trunc(period, moment))


def since(table: DataFrame, source_id: int, moment: datetime, period: str = "day") -> DataFrame:
    """Rows of one source created at or after ``moment``, oldest first.

    A table with its partition column ``created_part`` (the first day of a
    ``period``) is read from that partition on only.
    """
    if "created_part" in table.columns:
        table = table.where(F.col("created_part") >= _part(F.lit(moment), period)).drop("created_part")
    found = table.where((F.col("created_at") >= F.lit(moment)) & (F.col("source_id") == source_id))
    return found.orderBy("created_at", "id")


def since_each(table: DataFrame, marks: DataFrame, period: str = "day") -> DataFrame:
    """The same for many sources: ``marks`` holds one (source_id, since) row each.

    The earliest mark bounds the partitions that are read.
    """
    rows = table
    if "created_part" in table.columns:
        first = marks.agg(_part(F.min("since"), period).alias("first")).scalar()
        rows = table.where(F.col("created_part") >= first).drop("created_part")
    return (
        rows.join(marks.select("source_id", "since"), "source_id")
        .where(F.col("created_at") >= F.col("since"))
        .drop("since")
    )


def missing_codes(codes: DataFrame, sources: DataFrame) -> DataFrame:
    """Requested codes that name no source."""
    return codes.select("code").distinct().join(sources.select("code"), "code", "left_anti")


def require_codes(codes: DataFrame, sources: DataFrame, shown: int = 20) -> None:
    """Fail before anything is written if a requested code is unknown."""
    missing = [r["code"] for r in missing_codes(codes, sources).orderBy("code").limit(shown + 1).collect()]
    if missing:
        more = ", ..." if len(missing) > shown else ""
        names = ", ".join(f"'{c}'" for c in missing[:shown])
        raise ValueError(f"Source with code={names}{more} not found")


def require_field(name: str) -> str:
    if name not in BID_FIELDS:
        raise ValueError(f"unknown bid field {name!r}")
    return name


def search(
    bids: DataFrame,
    conditions: Sequence[Column],
    sort: str = "created_at",
    descending: bool = True,
    page_size: int = 50,
    after: tuple | None = None,
) -> DataFrame:
    """One page of matching bids in (sort, id) order, NULL sort values last.

    ``after`` is the (sort value, id) of the last row of the page before, so a
    deep page costs no more than the first; the page is a distributed top-k.
    """
    key, row_id, found = F.col(require_field(sort)), F.col("id"), bids
    for condition in conditions:
        found = found.where(condition)
    if after is not None:
        value, last_id = after
        tied = (row_id < last_id) if descending else (row_id > last_id)
        if value is None:
            found = found.where(key.isNull() & tied)
        else:
            beyond = (key < F.lit(value)) if descending else (key > F.lit(value))
            found = found.where(key.isNull() | beyond | ((key == F.lit(value)) & tied))
    order = (
        [key.desc_nulls_last(), row_id.desc()] if descending else [key.asc_nulls_last(), row_id.asc()]
    )
    return found.orderBy(*order).limit(page_size)
