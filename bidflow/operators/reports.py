"""Counters, daily statistics, shares, error roll-ups and alerts."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidflow.operators.ids import with_position


def job_counters(raw_items: DataFrame, bids: DataFrame, started: datetime, finished: datetime) -> DataFrame:
    """One finished job per source and batch, counted from the stored batch rows."""
    rows = raw_items.select("source_id", "batch_id", F.lit(1).alias("raw"), F.lit(0).alias("bid")).unionAll(
        bids.select("source_id", "batch_id", F.lit(0).alias("raw"), F.lit(1).alias("bid"))
    )
    return (
        rows.groupBy("source_id", "batch_id")
        .agg(F.sum("raw").alias("items_total"), F.sum("bid").alias("items_created"))
        .select(
            "source_id",
            "batch_id",
            F.lit("harvest").alias("job_type"),
            F.when(F.col("items_total") == F.col("items_created"), "done").otherwise("failed").alias("status"),
            F.lit(started).cast("timestamp").alias("started_at"),
            F.lit(finished).cast("timestamp").alias("finished_at"),
            F.col("items_total").cast("int"),
            F.col("items_created").cast("int"),
            F.lit(0).alias("items_updated"),
            F.when(F.col("items_total") != F.col("items_created"), "bids missing").alias("error_message"),
        )
    )


def outcome_counters(
    checked: DataFrame, bids: DataFrame, requested: DataFrame, started: datetime, finished: datetime
) -> DataFrame:
    """One finished job per source that was ``requested`` (source_id) or has ``checked`` rows (source_id, reason).

    ``reason`` tells why a row was rejected. A source has failed when it has
    rejected rows and no other ones.
    """
    zero, one = F.lit(0), F.lit(1)
    rejected = F.col("reason").isNotNull().cast("int")
    rows = (
        checked.select("source_id", one.alias("total"), rejected.alias("rejected"), zero.alias("created"))
        .unionAll(bids.select("source_id", zero, zero, one))
        .unionAll(requested.select("source_id", zero, zero, zero))
    )
    counts = rows.groupBy("source_id").agg(*[F.sum(c).cast("int").alias(c) for c in ("total", "rejected", "created")])
    none_left = (F.col("rejected") > 0) & (F.col("rejected") == F.col("total"))
    return counts.select(
        "source_id",
        F.lit("harvest").alias("job_type"),
        F.when(none_left, "failed").otherwise("done").alias("status"),
        F.lit(started).cast("timestamp").alias("started_at"),
        F.lit(finished).cast("timestamp").alias("finished_at"),
        F.col("total").alias("items_total"),
        F.col("created").alias("items_created"),
        zero.alias("items_updated"),
        F.when(F.col("rejected") > 0, F.format_string("%d of %d rows rejected", "rejected", "total")).alias("error_message"),
    )


def reprocess_counters(raw_items: DataFrame, rebuilt: DataFrame, started: datetime, finished: datetime) -> DataFrame:
    """One finished job per source of a reprocessing; ``rebuilt`` has ``_id`` where a bid was there before."""
    total = raw_items.groupBy("source_id").agg(F.count("*").alias("items_total"))
    made = rebuilt.groupBy("source_id").agg(
        F.count_if(F.col("_id").isNull()).alias("items_created"), F.count("_id").alias("items_updated")
    )
    zero = F.lit(0)
    return total.join(made, "source_id", "left").select(
        "source_id",
        F.lit("reprocess").alias("job_type"),
        F.lit("done").alias("status"),
        F.lit(started).cast("timestamp").alias("started_at"),
        F.lit(finished).cast("timestamp").alias("finished_at"),
        F.col("items_total").cast("int"),
        F.coalesce("items_created", zero).cast("int").alias("items_created"),
        F.coalesce("items_updated", zero).cast("int").alias("items_updated"),
        F.lit(None).cast("string").alias("error_message"),
    )


def _per_day(df: DataFrame, when: str, name: str) -> DataFrame:
    return (
        df.groupBy(F.to_date(when).alias("day"), "source_id")
        .agg(F.count("*").alias("n"))
        .select("day", "source_id", F.lit(name).alias("what"), "n")
    )


def daily_stats(raw_items: DataFrame, bids: DataFrame, errors: DataFrame) -> DataFrame:
    """Raw items, bids and errors per day and source, per day, and in all.

    ``level`` 0 is day and source, 1 is day, 3 is the grand total. Facts are
    counted per day and source first; the totals come from those few rows.
    """
    parts = [
        _per_day(raw_items, "created_at", "raw"),
        _per_day(bids, "created_at", "bid"),
        _per_day(errors, "occurred_at", "error"),
    ]
    counted = reduce(DataFrame.unionAll, parts)

    def total(what: str):
        return F.coalesce(F.sum(F.when(F.col("what") == what, F.col("n"))), F.lit(0))

    return counted.groupingSets(
        [("day", "source_id"), ("day",), ()], "day", "source_id"
    ).agg(
        F.grouping_id().cast("int").alias("level"),
        total("raw").alias("raw_items"),
        total("bid").alias("bids"),
        total("error").alias("errors"),
    )


def source_share(bids: DataFrame) -> DataFrame:
    """Bids per source and their part of all bids (the window sees one row per source)."""
    counts = bids.groupBy("source_id").agg(F.count("*").alias("bids"))
    return counts.withColumn("share", F.col("bids") / F.sum("bids").over(Window.partitionBy()))


def duplicate_counts(marked: DataFrame) -> DataFrame:
    """Bids and duplicates per day and source of bids whose duplicates are marked."""
    return marked.groupBy(F.to_date("created_at").alias("day"), "source_id").agg(
        F.count("*").alias("bids"), F.count_if("is_duplicate").alias("duplicates")
    )


def error_rollup(errors: DataFrame) -> DataFrame:
    """Errors by severity, source and day with all sub-totals.

    ``level`` is the grouping id: 0 full detail, 1 severity and source,
    3 severity, 7 all. ``jobs`` counts the errors that belong to a job.
    """
    counted = errors.groupBy("severity", "source_id", F.to_date("occurred_at").alias("day")).agg(
        F.count("*").alias("n"), F.count("job_id").alias("n_jobs")
    )
    return counted.rollup("severity", "source_id", "day").agg(
        F.grouping_id().cast("int").alias("level"),
        F.sum("n").alias("errors"),
        F.sum("n_jobs").alias("jobs"),
    )


def errors_by_job(errors: DataFrame) -> DataFrame:
    """Errors per job, with the first and last moment."""
    return (
        errors.where(F.col("job_id").isNotNull())
        .groupBy("job_id")
        .agg(
            F.count("*").alias("errors"),
            F.min("occurred_at").alias("first_at"),
            F.max("occurred_at").alias("last_at"),
        )
    )


def silent_sources(sources: DataFrame, bids: DataFrame, as_of: datetime, max_hours: float) -> DataFrame:
    """Active sources without a new bid for more than ``max_hours``, those that never had one included."""
    last = bids.groupBy("source_id").agg(F.max("created_at").alias("last_bid_at"))
    limit = F.lit(as_of) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(max_hours) * 3600))
    active = sources.where("is_enabled").select(F.col("id").alias("source_id"), "code")
    return active.join(last, "source_id", "left").where(
        F.col("last_bid_at").isNull() | (F.col("last_bid_at") < limit)
    )


# Rows per window task of ``job_durations``; also bounds the memory of a task.
BLOCK = 200_000


def job_durations(jobs: DataFrame, previous: int = 10, block: int = BLOCK) -> DataFrame:
    """Each finished job with the mean duration of the previous runs of its source.

    A window over a source would put all runs of a busy source in one task.
    Instead rows are numbered in (source, start, id) order and cut into blocks;
    each block also gets the ``previous`` rows before it, so every frame is whole.
    """
    if previous >= block:
        raise ValueError("previous must be smaller than block")
    micros = F.unix_micros("finished_at") - F.unix_micros("started_at")
    runs = jobs.where(F.col("started_at").isNotNull() & F.col("finished_at").isNotNull()).select(
        "id", "source_id", "started_at", micros.alias("duration_us")
    )
    placed = with_position(runs, ["source_id", "started_at", "id"])
    own = F.floor(F.col("position") / block)
    near_end = F.col("position") % block >= block - previous
    blocks = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
    frame = Window.partitionBy("block", "source_id").orderBy("position").rowsBetween(-previous, -1)
    return (
        placed.withColumn("block", F.explode(blocks))
        .withColumn("previous_runs", F.count("duration_us").over(frame))
        .withColumn("mean_us", F.sum("duration_us").over(frame) / F.col("previous_runs"))
        .where(F.col("block") == own)
        .drop("block", "position")
    )


def slow_jobs(durations: DataFrame, factor: float = 2.0, min_runs: int = 3) -> DataFrame:
    """Alert rows: a run took more than ``factor`` times the mean of the runs before it."""
    return durations.where(
        (F.col("previous_runs") >= min_runs) & (F.col("duration_us") > F.col("mean_us") * factor)
    )
