"""Harvest in which bad rows are set aside: a job for each source, an error for each rejected row."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidflow.operators.ids import with_dense_ids
from bidflow.operators.lookups import sources_by_codes
from bidflow.operators.reports import outcome_counters
from bidflow.plans.harvest import prepare, stage_batch, stage_jobs
from bidflow.plans.publish import Warehouse
from bidflow.schemas import ERRORS, MAX_LENGTHS
from bidflow.shared import cleared, staged

# Columns a raw item cannot do without.
NEEDED = ("payload", "created_at", "received_at")
# Order in which rejected rows get their ids.
ERROR_ORDER = ("source_id", "reason", "external_id", "url")


def rejection() -> Column:
    """Why a provided row cannot be stored; NULL if it can."""
    missing = [F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in NEEDED]
    limits = {c: n for c, n in MAX_LENGTHS["raw_items"].items() if c in ("external_id", "url")}
    long = [F.when(F.length(c) > n, F.lit(f"{c} is longer than {n}")) for c, n in limits.items()]
    return F.coalesce(*missing, *long)


def stage_errors(warehouse: Warehouse, batch_id: str, rejected: DataFrame, at: datetime) -> None:
    """Write an error row for each of ``rejected`` (source_id, external_id, url, reason), under its source's job of the batch."""
    numbered = with_dense_ids(rejected, ERROR_ORDER, after=warehouse.last_id("errors"))
    jobs = warehouse.staged("jobs", batch_id).select("source_id", F.col("id").alias("job_id"))
    when = F.lit(at).cast("timestamp")
    rows = numbered.join(jobs, "source_id", "left").withColumns(
        {
            "occurred_at": when,
            "severity": F.lit("error"),
            "message": F.col("reason"),
            "details": F.to_json(F.struct("external_id", "url")),
            "created_at": when,
        }
    )
    warehouse.stage("errors", batch_id, rows.select(*[F.col(f.name).cast(f.dataType) for f in ERRORS]))


def harvest_with_outcomes(
    warehouse: Warehouse,
    sources: DataFrame,
    provided: DataFrame,
    codes: DataFrame,
    batch_id: str,
    now: datetime,
    mode: str = "append",
    clock: Callable[[], datetime] | None = None,
) -> bool:
    """One harvest batch in which a bad row stops neither its source nor the others; False if it is committed already.

    Rows that cannot be stored become error rows. Every requested source gets a
    job, also one that provided nothing, so that the schedule knows it has run:
    ``failed`` if it has rejected rows and not one that could be stored, else
    ``done``. Items, bids, jobs and errors become visible in one commit. Jobs
    start ``now`` and finish when the rows are written, by ``clock`` (``now``
    again without one). Of rejected rows only ids, addresses and reasons are kept.
    """
    if warehouse.is_committed(batch_id):
        return False

    def work() -> bool:
        checked = prepare(provided, sources, codes).withColumn("reason", rejection())
        good = checked.where(F.col("reason").isNull()).select(*provided.columns)
        wrote = stage_batch(warehouse, sources, good, codes, batch_id, now, mode)
        bad = staged(checked.where(F.col("reason").isNotNull()).select(*ERROR_ORDER), "rejected")
        bids = warehouse.staged("bids", batch_id)
        finished = clock() if clock else now
        requested = sources_by_codes(sources, codes).select(F.col("id").alias("source_id"))
        stage_jobs(warehouse, batch_id, outcome_counters(checked, bids, requested, now, finished), finished)
        if not bad.isEmpty():
            stage_errors(warehouse, batch_id, bad, finished)
        return wrote or not warehouse.staged("jobs", batch_id).isEmpty()

    with cleared(warehouse.spark):
        return warehouse.attempt(batch_id, work, now)
