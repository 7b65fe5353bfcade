"""Structured Streaming: continuous harvest, dedup, window counts, silence alerts."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from bidflow.plans.harvest import harvest
from bidflow.plans.publish import Warehouse


def continuous_harvest(
    provided: DataFrame,
    warehouse: Warehouse,
    sources: DataFrame,
    codes: DataFrame,
    name: str,
    now: datetime | None = None,
    mode: str = "append",
) -> DataStreamWriter:
    """Harvest each micro-batch of landed items as one batch named after its epoch.

    A replayed epoch finds its batch committed and does nothing, or finds it
    unfinished and writes it anew; either way its rows are stored once.
    """

    def one(batch: DataFrame, epoch: int) -> None:
        harvest(warehouse, sources, batch, codes, f"{name}-{epoch:010d}", now or datetime.now(timezone.utc), mode)

    return provided.writeStream.foreachBatch(one)


def deduplicated(items: DataFrame, lateness: str, salt_by: list[str], slices: int = 32) -> DataFrame:
    """First item per (source_id, external_id) within the lateness bound; NULL equals NULL.

    Done twice: first inside slices of each key, so a flood under one key is
    thinned by many tasks, then once over the at most ``slices`` survivors per
    key. ``salt_by`` must be fixed for a row (such as an id or an offset), or a
    repeated task could send it elsewhere.
    """
    sliced = items.withColumn("_slice", F.pmod(F.xxhash64(*salt_by), F.lit(slices)))
    return (
        sliced.withWatermark("received_at", lateness)
        .dropDuplicatesWithinWatermark(["source_id", "external_id", "_slice"])
        .dropDuplicatesWithinWatermark(["source_id", "external_id"])
        .drop("_slice")
    )


def window_counts(items: DataFrame, when: str, size: str, lateness: str, slide: str | None = None) -> DataFrame:
    """Items per source and tumbling (or, with ``slide``, sliding) window, once a window is closed."""
    return (
        items.withWatermark(when, lateness)
        .groupBy(F.window(when, size, slide), "source_id")
        .agg(F.count("*").alias("items"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "source_id", "items")
    )


MAX_STEP_MINUTES = 10

ALERT = T.StructType(
    [
        T.StructField("source_id", T.LongType()),
        T.StructField("last_seen", T.TimestampType()),
        T.StructField("silent_since", T.TimestampType()),
    ]
)


def _silence(limit_ms: int, step_ms: int) -> StatefulProcessor:
    # Defined inside a function so that tasks need no copy of this package.
    class Silence(StatefulProcessor):
        """Remembers when a source was last heard; alerts on gaps longer than the limit."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", T.StructType([T.StructField("ms", T.LongType())]))

        def _alert(self, key, last_ms: int) -> pd.DataFrame:
            seen = pd.Timestamp(last_ms, unit="ms")
            return pd.DataFrame(
                {
                    "source_id": [key[0]],
                    "last_seen": [seen],
                    "silent_since": [seen + pd.Timedelta(milliseconds=limit_ms)],
                }
            )

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            heard = pd.concat(list(rows)).sort_values("first_ms")
            last = self.last.get()[0] if self.last.exists() else None
            for first_ms, last_ms in zip(heard["first_ms"].tolist(), heard["last_ms"].tolist()):
                if last is not None and first_ms - last > limit_ms:
                    yield self._alert(key, last)
                last = last_ms if last is None else max(last, last_ms)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.last.update((last,))
            # Not before the window that could hold an item just in time is closed.
            self.handle.registerTimer(-(-(last + limit_ms) // step_ms) * step_ms)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            yield self._alert(key, self.last.get()[0])
            # Heard again later, the same gap must not be reported a second time.
            self.last.clear()

        def close(self) -> None:
            pass

    return Silence()


def silence_alerts(items: DataFrame, when: str, limit_minutes: int, lateness: str) -> DataFrame:
    """One alert for every time a source is silent for longer than ``limit_minutes``.

    Items are first reduced to the first and last moment per source and window
    (with map-side combine), so the Python state sees a few rows per source no
    matter how many items it sends. Windows are no longer than the limit: a
    silence inside one is never too long. Needs the RocksDB state store provider.
    """
    step = min(limit_minutes, MAX_STEP_MINUTES)
    heard = (
        items.withWatermark(when, lateness)
        .groupBy(F.window(when, f"{step} minutes"), "source_id")
        .agg(F.min(F.unix_millis(when)).alias("first_ms"), F.max(F.unix_millis(when)).alias("last_ms"))
        .select("source_id", "first_ms", "last_ms", F.window_time("window").alias("at"))
    )
    return heard.groupBy("source_id").transformWithStateInPandas(
        statefulProcessor=_silence(limit_minutes * 60_000, step * 60_000),
        outputStructType=ALERT,
        outputMode="Append",
        timeMode="EventTime",
    )


def drain(writer: DataStreamWriter, checkpoint: str) -> None:
    """Run a stream over everything that has landed so far, then stop."""
    query: StreamingQuery = (
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def drain_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run an append-mode stream into parquet files (exactly once) and read them back."""
    drain(stream.writeStream.outputMode("append").format("parquet").option("path", path), checkpoint)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
