"""Streams over files that arrive one by one."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import rows as R
from bidflow import schemas
from bidflow.plans.publish import Warehouse
from bidflow.streaming import streams

NOW = datetime(2025, 12, 3)
EVENT = "source_id long, at timestamp, place long"


def land(spark, folder, batches, schema):
    """Write each list of rows as a file of its own, in order of arrival."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def arrive(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_continuous_harvest_and_replay(spark, tmp_path):
    src, codes = R.sources(spark, [(1, "A", "A", True)]), R.codes(spark, "A")
    warehouse = Warehouse(spark, str(tmp_path / "wh"))
    for part in ([("A", 0, "e1", "p"), ("A", 0, "e2", "p")], [("A", 0, "e3", "p")]):
        R.provided(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    items = arrive(spark, tmp_path / "in", schemas.PROVIDED)

    def run(checkpoint):
        streams.drain(streams.continuous_harvest(items, warehouse, src, codes, "q", NOW), str(tmp_path / checkpoint))

    run("c1")
    assert warehouse.read("bids").count() == 3 and warehouse.manifest().count() == 2
    run("c1")
    assert warehouse.read("bids").count() == 3
    # A lost checkpoint makes the query start over with the same epochs.
    run("c2")
    assert warehouse.read("bids").count() == 3
    assert sorted(r.id for r in warehouse.read("bids").collect()) == [1, 2, 3]


def test_dedup_across_batches_with_a_flood(spark, tmp_path):
    def rows(start, n, key):
        return [(1, key, R.T0 + timedelta(seconds=start + i), start + i) for i in range(n)]

    schema = "source_id long, external_id string, received_at timestamp, place long"
    batches = [rows(0, 200, "hot") + rows(300, 1, None), rows(400, 100, "hot") + rows(600, 2, None) + rows(700, 1, "other")]
    land(spark, tmp_path / "in", batches, schema)
    items = arrive(spark, tmp_path / "in", schema)
    unique = streams.deduplicated(items, "1 day", ["place"], slices=4).select("external_id")
    out = streams.drain_to_table(unique, str(tmp_path / "out"), str(tmp_path / "c"))
    assert sorted(str(r.external_id) for r in out.collect()) == ["None", "hot", "other"]


def test_window_counts_close_with_the_watermark(spark, tmp_path):
    at = [R.T0 + timedelta(minutes=m) for m in (1, 2, 11, 35)]
    later = [[(1, R.T0 + timedelta(minutes=m), 10 + m)] for m in (36, 3)]
    land(spark, tmp_path / "in", [[(1, t, i) for i, t in enumerate(at)], *later], EVENT)
    counts = streams.window_counts(arrive(spark, tmp_path / "in", EVENT), "at", "10 minutes", "5 minutes")
    out = streams.drain_to_table(counts, str(tmp_path / "out"), str(tmp_path / "c"))
    # The last file is too late for its window; the window of minutes 35 and 36 is still open.
    assert {(r.window_start.minute, r.items) for r in out.collect()} == {(0, 2), (10, 1)}


@pytest.fixture()
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def test_silence_alerts_do_not_depend_on_batches(spark, tmp_path, rocksdb):
    minutes = {1: [0, 30, 200, 210, 600], 2: [5, 100, 190, 280, 370, 460, 550, 605], 3: [10]}
    events = sorted((R.T0 + timedelta(minutes=m), s) for s, all_m in minutes.items() for m in all_m)
    rows = [(s, t, i) for i, (t, s) in enumerate(events)]
    expected = {(1, 30), (1, 210), (3, 10)}
    for name, batches in (("one", [rows]), ("many", [rows[:4], rows[4:9], rows[9:]])):
        land(spark, tmp_path / name, batches, EVENT)
        alerts = streams.silence_alerts(arrive(spark, tmp_path / name, EVENT), "at", 120, "10 minutes")
        out = streams.drain_to_table(alerts, str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-c"))
        found = [(r.source_id, int((r.last_seen - R.T0).total_seconds() // 60)) for r in out.collect()]
        assert sorted(found) == sorted(expected), name
        assert out.where(F.col("silent_since") != F.col("last_seen") + F.expr("interval 2 hours")).count() == 0


def test_short_silences_are_seen(spark, tmp_path, rocksdb):
    events = [(1, R.T0 + timedelta(minutes=m), i) for i, m in enumerate([0, 2, 8, 9, 60])]
    land(spark, tmp_path / "in", [events], EVENT)
    alerts = streams.silence_alerts(arrive(spark, tmp_path / "in", EVENT), "at", 5, "1 minute")
    out = streams.drain_to_table(alerts, str(tmp_path / "out"), str(tmp_path / "c"))
    assert sorted(int((r.last_seen - R.T0).total_seconds() // 60) for r in out.collect()) == [2, 9]
