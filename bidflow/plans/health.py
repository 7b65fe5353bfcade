"""Daily health report and harvesting of everything that is due."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidflow.operators.schedule import due_sources, job_state
from bidflow.plans.harvest import harvest
from bidflow.plans.publish import Warehouse
from bidflow.shared import staged


def _rows(df: DataFrame, section: str, source, name, value) -> DataFrame:
    return df.select(
        F.lit(section).alias("section"),
        source.cast("bigint").alias("source_id"),
        name.cast("string").alias("name"),
        value.cast("double").alias("value"),
    )


def health_report(
    sources: DataFrame,
    raw_items: DataFrame,
    marked_bids: DataFrame,
    errors: DataFrame,
    day: date,
    silent_hours: float,
) -> DataFrame:
    """Everything worth knowing about one day, as (section, source_id, name, value) rows.

    Each table is read once and reduced to a row per source, which is written;
    all sections come from these few rows.
    """
    start = datetime(day.year, day.month, day.day)
    end = start + timedelta(days=1)

    def today(column: str):
        return (F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(end))

    zero = F.lit(0)
    raw = raw_items.where(today("created_at")).groupBy("source_id").agg(F.count("*").alias("n"))
    past = marked_bids.where(F.col("created_at") < F.lit(end))
    bids = past.groupBy("source_id").agg(
        F.count_if(today("created_at")).alias("n"),
        F.count_if(today("created_at") & F.col("is_duplicate")).alias("n_duplicates"),
        F.max("created_at").alias("last_bid_at"),
    )
    bids = staged(bids, "health-bids")
    failures = errors.where(today("occurred_at")).groupBy("severity", "source_id").agg(F.count("*").alias("n"))
    failures = staged(failures, "health-errors")
    of_day = bids.where("n > 0")
    facts = (
        raw.select("source_id", F.col("n").alias("raw_items"), zero.alias("bids"), zero.alias("errors"))
        .unionAll(of_day.select("source_id", zero, "n", zero))
        .unionAll(failures.select("source_id", zero, zero, "n"))
    )
    names = ("raw_items", "bids", "errors")
    stats = facts.groupBy("source_id").agg(*[F.sum(n).alias(n) for n in names])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names]))
    counts = stats.select("source_id", pairs.alias("p"))
    share = of_day.select("source_id", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))
    limit = F.lit(end) - F.make_dt_interval(zero, zero, zero, F.lit(float(silent_hours) * 3600))
    active = sources.where("is_enabled").select(F.col("id").alias("source_id"), "code")
    silent = active.join(bids.select("source_id", "last_bid_at"), "source_id", "left").where(
        F.col("last_bid_at").isNull() | (F.col("last_bid_at") < limit)
    )
    by_severity = failures.groupBy("severity").agg(F.sum("n").alias("n"))
    own = F.col("source_id")
    return reduce(
        DataFrame.unionAll,
        [
            _rows(counts, "counts", own, F.col("p.name"), F.col("p.value")),
            _rows(share, "share", own, F.lit("share"), F.col("share")),
            _rows(of_day, "duplicates", own, F.lit("duplicates"), F.col("n_duplicates")),
            _rows(by_severity, "errors", F.lit(None), F.col("severity"), F.col("n")),
            _rows(silent, "silent", own, F.col("code"), F.lit(1)),
        ],
    )


def harvest_due(
    warehouse: Warehouse,
    sources: DataFrame,
    jobs: DataFrame,
    config_schedule: DataFrame,
    provided: DataFrame,
    batch_id: str,
    now: datetime,
    mode: str = "append",
) -> bool:
    """Harvest every due source in one batch; Spark's partitions are the parallelism."""
    due = due_sources(sources, job_state(jobs), config_schedule, now).select("code")
    return harvest(warehouse, sources, provided, due, batch_id, now, mode)
