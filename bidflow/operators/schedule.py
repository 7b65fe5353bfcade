"""Which sources are due, from their schedules and their past jobs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidflow.operators.skew import HOT_ROWS, attach_group

SCHEDULE_DATA = "source_code string, interval_minutes int, backoff_factor double, max_backoff_minutes int"
SOURCE_DATA = "source_code string, max_per_hour int, delay_ms int, priority int"


def source_settings(sources: DataFrame, config_source: DataFrame) -> DataFrame:
    """Every source with its active settings, NULL where it has none."""
    settings = config_source.where("is_active").select(F.from_json("data", SOURCE_DATA).alias("d")).select("d.*")
    return sources.join(settings, F.col("code") == F.col("source_code"), "left").drop("source_code")


def job_state(jobs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per source: last job, and how many jobs failed since the last good one."""
    runs = jobs.where(F.col("source_id").isNotNull() & F.col("started_at").isNotNull()).select(
        "id", "source_id", "started_at", "status"
    )
    place = F.struct("started_at", "id")
    failed = F.col("status") == "failed"
    last = runs.groupBy("source_id").agg(
        F.count_if(failed).alias("n_rows"),
        F.max(F.struct("started_at", "id", "status")).alias("last"),
        F.max(F.when(~failed, place)).alias("last_good"),
    )
    # The failed runs of a busy source meet its one row without being gathered.
    since_good = (
        attach_group(runs.where(failed), last.select("source_id", "n_rows", "last_good"), ["source_id"], "inner", hot_rows=hot_rows)
        .where(F.col("last_good").isNull() | (place > F.col("last_good")))
        .groupBy("source_id")
        .agg(F.count("*").alias("failures"))
    )
    return last.join(since_good, "source_id", "left").select(
        "source_id",
        F.col("last.id").alias("last_job_id"),
        F.col("last.started_at").alias("last_started_at"),
        F.col("last.status").alias("last_status"),
        F.coalesce("failures", F.lit(0)).cast("bigint").alias("failures"),
    )


def due_sources(sources: DataFrame, state: DataFrame, config_schedule: DataFrame, as_of: datetime) -> DataFrame:
    """Active scheduled sources whose next run is due.

    The wait is the interval, multiplied by the back-off factor for every failure
    since the last good run, up to the configured maximum. A source that never
    ran is due at once.
    """
    plan = config_schedule.where("is_active").select(F.from_json("data", SCHEDULE_DATA).alias("d")).select("d.*")
    grown = F.col("interval_minutes") * F.pow(F.col("backoff_factor"), F.col("failures"))
    longest = F.greatest("max_backoff_minutes", "interval_minutes")
    wait = F.when(F.coalesce("failures", F.lit(0)) == 0, F.col("interval_minutes")).otherwise(F.least(grown, longest))
    next_due = F.col("last_started_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.round(wait * 60))
    return (
        sources.where("is_enabled")
        .select(F.col("id").alias("source_id"), "code")
        .join(plan, F.col("code") == F.col("source_code"))
        .join(state, "source_id", "left")
        .withColumn("next_due_at", next_due)
        .where(F.col("next_due_at").isNull() | (F.col("next_due_at") <= F.lit(as_of)))
        .select("source_id", "code", F.coalesce("failures", F.lit(0)).alias("failures"), "last_started_at", "next_due_at")
    )


def unreachable_sources(sources: DataFrame, state: DataFrame, min_failures: int = 3) -> DataFrame:
    """Alert rows: active sources whose last runs failed, at least ``min_failures`` in a row."""
    return (
        sources.where("is_enabled")
        .select(F.col("id").alias("source_id"), "code")
        .join(state.where(F.col("failures") >= min_failures), "source_id")
        .select("source_id", "code", "failures", "last_started_at")
    )
