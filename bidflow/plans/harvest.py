"""Harvest: take provided raw items of a set of sources, store them and one bid each."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidflow.functions.keys import content_hash, item_key
from bidflow.operators.ids import with_dense_ids
from bidflow.operators.lookups import require_codes, sources_by_codes
from bidflow.operators.mapping import backfill_source, bid_from_entity, build_bids, raw_from_entity
from bidflow.operators.reports import job_counters
from bidflow.plans.publish import Warehouse
from bidflow.schemas import JOBS
from bidflow.shared import cleared, staged

# Order in which new raw items get their ids.
INSERT_ORDER = ("source_id", "external_id", "_hash", "received_at", "url")

# What bids are built from beside the columns of a raw item.
SOURCE_COLUMNS = ("source_code", "source_name")


def unseen(provided: DataFrame, keys: DataFrame) -> DataFrame:
    """Provided items whose key (source, external id and content) is not in ``keys`` (key).

    AQE splits a key that many provided rows share.
    """
    return provided.withColumn("key", item_key()).join(keys.select("key"), "key", "left_anti").select(*provided.columns)


def prepare(provided: DataFrame, sources: DataFrame, codes: DataFrame) -> DataFrame:
    """Provided rows of the requested sources, with source ids filled in."""
    require_codes(codes, sources)
    return backfill_source(provided, sources_by_codes(sources, codes))


def log_jobs(warehouse: Warehouse, batch_id: str, now: datetime) -> None:
    """One job row per source of a harvest, counted from the files as written."""
    parts = [warehouse.staged(t, batch_id).withColumn("batch_id", F.lit(batch_id)) for t in ("raw_items", "bids")]
    stage_jobs(warehouse, batch_id, job_counters(*parts, now, now), now)


def stage_jobs(warehouse: Warehouse, batch_id: str, counters: DataFrame, now: datetime) -> None:
    """Write job rows of a batch, numbered after those stored (the window sees one row per source)."""
    last = warehouse.last_id("jobs")
    numbered = counters.withColumns(
        {"id": F.row_number().over(Window.orderBy("source_id")) + F.lit(last), "created_at": F.lit(now).cast("timestamp")}
    )
    warehouse.stage("jobs", batch_id, numbered.select(*[F.col(f.name).cast(f.dataType) for f in JOBS]))


def number_raw(prepared: DataFrame, after: int) -> DataFrame:
    """Raw entities with ids, plus the source attributes bids are built from."""
    hashed = prepared.withColumn("_hash", content_hash(F.col("payload")))
    return with_dense_ids(hashed, INSERT_ORDER, after=after).drop("_hash")


def bids_of(numbered: DataFrame, now: datetime, shift: int) -> DataFrame:
    """Stored form of the bids; ids run in the order of the raw ids."""
    entities = build_bids(numbered, now).withColumn("id", F.col("raw_item_id") + F.lit(shift))
    return bid_from_entity(entities)


def stage_batch(
    warehouse: Warehouse,
    sources: DataFrame,
    provided: DataFrame,
    codes: DataFrame,
    batch_id: str,
    now: datetime,
    mode: str = "append",
) -> bool:
    """Write a batch without committing it; False when there is nothing to write.

    ``append`` takes everything provided, again on every run. ``idempotent``
    takes only what is not stored yet, by the stored keys; stored payloads are
    not read. What is provided is written once, numbered without its payloads,
    and meets its ids by its place in the files. Bids, all created now, are built
    from the raw items as written, so payloads meet their ids and days only once.
    """
    if mode not in ("append", "idempotent"):
        raise ValueError(f"mode must be 'append' or 'idempotent', not {mode!r}")
    last_raw, last_bid = warehouse.begin(batch_id)
    keyed = prepare(provided, sources, codes).withColumns({"_hash": content_hash(F.col("payload")), "key": item_key()})
    rows = staged(keyed, "provided").select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")
    )
    thin = rows.select(*INSERT_ORDER, "key", "_file", "_row")
    if mode == "idempotent":
        thin = thin.join(warehouse.read("raw_keys").select("key"), "key", "left_anti")
    ids = with_dense_ids(thin.drop("key"), INSERT_ORDER, after=last_raw, place=["_file", "_row"]).select("id", "_file", "_row")
    if ids.isEmpty():
        return False
    numbered = rows.join(ids, ["_file", "_row"])
    warehouse.stage("raw_items", batch_id, raw_from_entity(numbered, SOURCE_COLUMNS))
    stored = warehouse.staged("raw_items", batch_id, SOURCE_COLUMNS)
    warehouse.stage("bids", batch_id, bids_of(stored, now, last_bid - last_raw), one_day=True)
    return True


def harvest(
    warehouse: Warehouse,
    sources: DataFrame,
    provided: DataFrame,
    codes: DataFrame,
    batch_id: str,
    now: datetime,
    mode: str = "append",
) -> bool:
    """Run one harvest batch for a set of source codes; True when something was published.

    An unknown code is an error and nothing is written. No rows: nothing is
    committed and that is no error. A batch id that is committed already is not
    run again.
    """
    if warehouse.is_committed(batch_id):
        require_codes(codes, sources)
        return False

    def work() -> bool:
        if not stage_batch(warehouse, sources, provided, codes, batch_id, now, mode):
            return False
        log_jobs(warehouse, batch_id, now)
        return True

    with cleared(warehouse.spark):
        return warehouse.attempt(batch_id, work, now)
