"""Mappings, ids, publishing, harvest, upsert."""

import itertools
import json
import time
from datetime import datetime, timedelta
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import rows as R
from bidflow import schemas
from bidflow.operators import evolve, lookups, mapping
from bidflow.operators.ids import with_dense_ids, with_position
from bidflow.operators.upsert import upsert_sources
from bidflow.plans.harvest import harvest, stage_batch
from bidflow.plans.outcomes import harvest_with_outcomes
from bidflow.plans.publish import Warehouse
from bidflow.plans.refine import reprocess
from bidflow.sources.providers import stub_items
from bidflow.sources.tables import read_config, read_table

NOW = datetime(2025, 12, 3, 10, 15)


@pytest.fixture()
def warehouse(spark, tmp_path):
    return Warehouse(spark, str(tmp_path / "wh"))


def test_bid_round_trip(spark):
    stored = R.bids(spark, [
        {"weight_value": Decimal("30.000"), "price_value": Decimal("25000.00"), "price_currency": "RUB", "description": None},
        {"weight_value": Decimal("0.000"), "load_region": "lost on the way"},
        {"weight_unit": "kg"},
    ])
    entities = mapping.bid_to_entity(stored)
    assert entities.schema.fieldNames() == schemas.BID_ENTITY.fieldNames()
    first, second, third = entities.orderBy("id").collect()
    assert (first.price, first.weight_tons, first.description) == (25000.0, 30.0, "")
    back = mapping.bid_from_entity(entities).orderBy("id").collect()
    assert back[0].price_value == Decimal("25000.00") and back[0].weight_unit == "t"
    assert back[1].weight_unit == "t" and back[1].load_region is None
    assert back[2].weight_unit is None and back[2].received_at is None and back[2].is_duplicate is False
    assert back[0].updated_at == back[0].created_at


def test_backfill_keeps_foreign_ids(spark):
    src = R.sources(spark, [(1, "ati", "ATI", True)])
    raw = R.provided(spark, [("ati", 0, "a", "p"), ("ati", 7, "b", "p")])
    assert {r.external_id: r.source_id for r in mapping.backfill_source(raw, src).collect()} == {"a": 1, "b": 7}


def test_sources_versions_there_and_back(spark):
    v1 = spark.createDataFrame([(1, "a", "html", 5, "u")], "id long, code string, type string, priority int, base_url string")
    v3 = evolve.sources_v2_to_v3(evolve.sources_v1_to_v2(v1))
    assert set(v3.columns) == {"id", "code", "kind", "description"}
    again = evolve.sources_v2_to_v1(evolve.sources_v3_to_v2(v3)).first()
    assert (again.type, again.priority, again.base_url) == ("html", 0, None)


def test_dense_ids_equal_a_global_row_number(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 1013).alias("k"), F.col("id").alias("v")).repartition(13)
    got = {(r.v): r.id for r in with_dense_ids(df, ["k", "v"], after=100).collect()}
    expected = sorted((v * 7919 % 1013, v) for v in range(5000))
    assert got == {v: 101 + i for i, (_, v) in enumerate(expected)}


def test_equal_rows_are_spread_and_numbered_once(spark):
    # Two thirds of the rows are the same row.
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("k"))
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "false")
    try:
        placed = with_position(df, ["k"]).cache()
        assert placed.where("k = -1").select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset(merging)
    assert placed.select("position").distinct().count() == 30000
    assert placed.agg(F.max("position")).first()[0] == 29999
    assert placed.where("k = -1").agg(F.max("position")).first()[0] == 19999


def test_no_rows_get_no_ids(spark):
    assert with_dense_ids(spark.range(0).withColumnRenamed("id", "k"), ["k"]).count() == 0


def test_stub_items(spark):
    src = R.sources(spark, [(1, "ati", "ATI", True), (2, "x", "X", False)])
    made = stub_items(src, NOW).orderBy("source_id").collect()
    assert made[0].external_id == "stub-ati-20251203101500" and made[0].source_id == 1
    assert made[0].payload == "Stub payload for source ati at 2025-12-03T10:15:00"
    assert made[0].url is None and made[0].created_at == made[0].received_at == NOW
    many = stub_items(src, NOW, copies=3)
    assert many.count() == 6 and many.select("external_id").distinct().count() == 6


def test_harvest_stores_items_and_bids(spark, warehouse):
    src = R.sources(spark, [(1, "ATI", "ATI", True)])
    items = R.provided(spark, [("ATI", 0, "ext-1", "p1"), ("ATI", 0, "ext-2", "p2")])
    assert harvest(warehouse, src, items, R.codes(spark, "ATI"), "b1", NOW)
    raw, bids = warehouse.read("raw_items").orderBy("id").collect(), warehouse.read("bids").orderBy("id").collect()
    assert [r.external_id for r in raw] == [b.external_id for b in bids] == ["ext-1", "ext-2"]
    assert [r.id for r in raw] == [b.raw_item_id for b in bids] == [1, 2]
    assert all(b.source_id == 1 and b.created_at == NOW for b in bids)
    assert bids[0].title == "ATI: заявка ext-1" and bids[0].description == "p1"
    assert raw[0].status == "new" and raw[0].hash is None
    assert set(warehouse.read("bids").columns) == set(schemas.BIDS.fieldNames())


def test_unknown_code_fails_and_writes_nothing(spark, warehouse):
    src = R.sources(spark, [(1, "ATI", "ATI", True)])
    items = R.provided(spark, [("ATI", 0, "e", "p")])
    with pytest.raises(ValueError, match="UNKNOWN"):
        harvest(warehouse, src, items, R.codes(spark, "ATI", "UNKNOWN"), "b1", NOW)
    assert warehouse.read("raw_items").count() == 0 and warehouse.manifest().count() == 0


def test_codes_are_case_sensitive(spark):
    src = R.sources(spark, [(1, "ATI", "ATI", True)])
    assert lookups.source_by_code(src, "ati").count() == 0


def test_nothing_provided_is_no_error(spark, warehouse):
    src = R.sources(spark, [(1, "ATI", "ATI", True)])
    assert harvest(warehouse, src, R.provided(spark, []), R.codes(spark, "ATI"), "b1", NOW) is False
    assert warehouse.manifest().count() == 0


def test_inactive_sources_are_harvested_when_named(spark, warehouse):
    src = R.sources(spark, [(1, "ATI", "ATI", False)])
    assert harvest(warehouse, src, R.provided(spark, [("ATI", 0, "e", "p")]), R.codes(spark, "ATI"), "b1", NOW)


def test_append_doubles_idempotent_does_not(spark, warehouse):
    src = R.sources(spark, [(1, "A", "A", True)])
    items = R.provided(spark, [("A", 0, "e1", "p"), ("A", 0, None, "q"), ("A", 0, None, "r")])
    code = R.codes(spark, "A")
    harvest(warehouse, src, items, code, "b1", NOW, "idempotent")
    assert harvest(warehouse, src, items, code, "b2", NOW, "idempotent") is False
    assert warehouse.read("bids").count() == 3
    harvest(warehouse, src, items, code, "b3", NOW, "append")
    assert sorted(r.id for r in warehouse.read("bids").collect()) == [1, 2, 3, 4, 5, 6]
    changed = R.provided(spark, [("A", 0, "e1", "new text"), ("A", 0, None, "q")])
    harvest(warehouse, src, changed, code, "b4", NOW, "idempotent")
    assert warehouse.read("raw_items").count() == 7


def test_a_batch_is_published_once(spark, warehouse):
    src, items = R.sources(spark, [(1, "A", "A", True)]), R.provided(spark, [("A", 0, "e", "p")])
    assert harvest(warehouse, src, items, R.codes(spark, "A"), "b1", NOW)
    assert harvest(warehouse, src, items, R.codes(spark, "A"), "b1", NOW) is False
    assert warehouse.read("bids").count() == 1


def test_uncommitted_batches_are_invisible_and_replaced(spark, warehouse):
    src, code = R.sources(spark, [(1, "A", "A", True)]), R.codes(spark, "A")
    harvest(warehouse, src, R.provided(spark, [("A", 0, "e", "p")]), code, "b1", NOW)
    lost = R.provided(spark, [("A", 0, "x", "p"), ("A", 0, "y", "p")])
    assert stage_batch(warehouse, src, lost, code, "b2", NOW)
    assert warehouse.read("raw_items").count() == warehouse.read("bids").count() == 1
    harvest(warehouse, src, R.provided(spark, [("A", 0, "z", "p")]), code, "b2", NOW)
    assert {r.external_id for r in warehouse.read("bids").collect()} == {"e", "z"}
    assert sorted(r.id for r in warehouse.read("raw_items").collect()) == [1, 2]


def test_many_day_batches_keep_every_row(spark, warehouse):
    rows = R.raw_items(spark, [(i, 1, str(i), "p") for i in range(1, 201)])
    spread = rows.withColumn("created_at", F.col("created_at") + F.make_dt_interval((F.col("id") % 40).cast("int")))
    warehouse.stage("raw_items", "b1", spread)
    found = warehouse.staged("raw_items", "b1")
    assert found.count() == 200 and found.select("created_part").distinct().count() == 40


def test_payloads_of_a_harvest_meet_their_ids_and_days_once(spark, warehouse, monkeypatch):
    """Bids come from the raw items as written: without a second join, and without a shuffle, all being of one day."""
    plans, stage = {}, Warehouse.stage

    def watched(self, table, batch_id, rows, *more, **named):
        plans[table] = rows._jdf.queryExecution().optimizedPlan().toString()
        stage(self, table, batch_id, rows, *more, **named)

    monkeypatch.setattr(Warehouse, "stage", watched)
    src = R.sources(spark, [(1, "A", "Ann", True), (2, "B", "", True)])
    items = R.provided(spark, [("A", 0, "e", "one"), ("B", 0, None, "two"), ("A", 2, None, "three"), ("B", 0, "e", "four")])
    assert harvest(warehouse, src, items, R.codes(spark, "A", "B"), "b1", NOW)
    assert "Join" in plans["raw_items"] and "Join" not in plans["bids"]
    assert warehouse.read("raw_items").columns == schemas.RAW_ITEMS.fieldNames()
    got = {r.description: (r.raw_item_id, r.source_id, r.title) for r in warehouse.read("bids").collect()}
    raw = {r.payload: (r.id, r.source_id) for r in warehouse.read("raw_items").collect()}
    assert {text: found[:2] for text, found in got.items()} == raw
    assert got["one"][2] == "Ann: заявка e" and got["four"][2] == "B: заявка e"
    # The source a row came from names the bid, whatever source it claims.
    assert got["three"][2] == f"Ann: заявка {got['three'][0]}"


def raw_of(spark, warehouse, batch, count, first=0, days=0):
    src = R.sources(spark, [(1, "A", "A", True)])
    items = R.provided(spark, [("A", 0, f"e{i}", f"p{i}") for i in range(first, first + count)])
    if days:
        items = items.withColumn("created_at", F.col("created_at") + F.make_dt_interval(F.lit(days)))
    assert harvest(warehouse, src, items, R.codes(spark, "A"), batch, NOW)
    return src


def configuration(spark, **tables):
    names = ("config_classifier", "config_filter_rule", "config_dedup")
    rows = {n: [(i, c, c, True, json.dumps(d), R.T0, R.T0) for i, (c, d) in enumerate(tables.get(n, {}).items())] for n in names}
    return {n: spark.createDataFrame(rows[n], schemas.CONFIG) for n in names}


def test_reprocessing_brings_rejected_bids_back_and_can_be_repeated(spark, warehouse):
    src = raw_of(spark, warehouse, "b1", 4)
    places = spark.createDataFrame([], "alias string, place string, region string")
    anything = {"c": {"target": "cargo_type", "value": "x", "priority": 1, "keywords": [], "regex": "."}}
    strict = {"r": {"mode": "include", "field": "description", "op": "in", "values": ["p0", "p1"]}}
    reprocess(warehouse, ["b1"], "r1", src, places, configuration(spark, config_classifier=anything, config_filter_rule=strict), NOW)
    assert sorted(r.id for r in warehouse.read("bids").collect()) == [1, 2]
    loose = configuration(spark, config_classifier=anything)
    for batch, of in (("r2", ["b1"]), ("r3", ["b1", "r1"]), ("r4", ["r2"])):
        assert reprocess(warehouse, of, batch, src, places, loose, NOW)
        found = warehouse.read("bids").orderBy("id").collect()
        assert [(r.id, r.raw_item_id, r.created_at) for r in found] == [(i, i, NOW) for i in (1, 2, 3, 4)], batch
    assert reprocess(warehouse, ["b1"], "r4", src, places, loose, NOW) is False
    with pytest.raises(ValueError, match="nowhere"):
        reprocess(warehouse, ["nowhere"], "r5", src, places, loose, NOW)
    jobs = {r.batch_id: r for r in warehouse.read("jobs", keep_partition=True).collect()}
    assert (jobs["r1"].items_total, jobs["r1"].items_created, jobs["r1"].items_updated) == (4, 0, 2)
    assert (jobs["b1"].job_type, jobs["b1"].items_created, jobs["r2"].items_updated) == ("harvest", 4, 4)
    assert sorted(r.id for r in jobs.values()) == [1, 2, 3, 4, 5]


def test_raw_items_without_a_bid_get_new_ids(spark, warehouse):
    src = raw_of(spark, warehouse, "b1", 2)
    raw = warehouse.read("raw_items").withColumns({"id": F.col("id") + 10, "external_id": F.lit("only raw")})
    warehouse.stage("raw_items", "b2", raw)
    warehouse.commit("b2", NOW)
    places = spark.createDataFrame([], "alias string, place string, region string")
    anything = {"c": {"target": "cargo_type", "value": "x", "priority": 1, "keywords": [], "regex": "."}}
    reprocess(warehouse, ["b2"], "r1", src, places, configuration(spark, config_classifier=anything), NOW)
    assert {r.raw_item_id: r.id for r in warehouse.read("bids").collect()} == {1: 1, 2: 2, 11: 3, 12: 4}


def test_manifest_is_folded_and_reads_name_their_folders(spark, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path / "wh"), log_files=3)
    rows = R.raw_items(spark, [(1, 1, "a", "p")])
    for i in range(8):
        warehouse.stage("raw_items", f"b{i}", rows.withColumn("id", F.lit(i + 1).cast("bigint")))
        warehouse.commit(f"b{i}", NOW)
    assert sorted(warehouse.batches()) == [f"b{i}" for i in range(8)]
    assert warehouse.last_ids() == (8, 0) and warehouse.read("raw_items").count() == 8
    files = {f for f in warehouse.manifest().inputFiles()}
    assert len(files) <= 4 and any("snapshot-2" in f for f in files)
    warehouse.stage("raw_items", "open", rows)
    assert not any("batch_id=open" in f for f in warehouse.read("raw_items").inputFiles())


def test_idempotent_harvest_reads_keys_only(spark, warehouse):
    raw_of(spark, warehouse, "b1", 3)
    known = warehouse.read("raw_keys")
    assert known.columns == ["source_id", "key"] and known.count() == 3
    text = known.select("key")._jdf.queryExecution().executedPlan().toString()
    assert "payload" not in text


def test_two_writers_cannot_take_the_same_ids(spark, warehouse):
    src = raw_of(spark, warehouse, "b1", 1)
    items = R.provided(spark, [("A", 0, "x", "p")])
    assert stage_batch(warehouse, src, items, R.codes(spark, "A"), "b2", NOW)
    other = Warehouse(spark, warehouse.root)
    harvest(other, src, R.provided(spark, [("A", 0, "y", "p")]), R.codes(spark, "A"), "b3", NOW)
    with pytest.raises(RuntimeError, match="b2"):
        warehouse.commit("b2", NOW)
    assert sorted(warehouse.batches()) == ["b1", "b3"]


def test_retention_and_deletes_are_published(spark, warehouse):
    src = raw_of(spark, warehouse, "b1", 2)
    raw_of(spark, warehouse, "b2", 2, first=2, days=30)
    warehouse.replace("sources", R.sources(spark, [(1, "A", "A", True), (2, "B", "B", True)]))
    cutoff = datetime(R.T0.year, R.T0.month, R.T0.day + 10)
    assert warehouse.retain("t1", cutoff, NOW)
    assert sorted(r.id for r in warehouse.read("raw_items").collect()) == [3, 4]
    assert {r.id: r.raw_item_id for r in warehouse.read("bids").collect()} == {1: None, 2: None, 3: 3, 4: 4}
    assert warehouse.retain("t2", cutoff, NOW) is False
    with pytest.raises(ValueError, match="bids"):
        warehouse.delete_sources("d1", src, NOW)
    warehouse.delete_sources("d2", warehouse.current("sources").where("id = 2"), NOW)
    assert [r.id for r in warehouse.current("sources").collect()] == [1]


def test_since_prunes_day_folders(spark, warehouse):
    raw_of(spark, warehouse, "b1", 2)
    raw_of(spark, warehouse, "b2", 2, first=2, days=30)
    moment = R.T0 + timedelta(days=30)
    items = warehouse.read("raw_items", keep_partition=True)
    marks = spark.createDataFrame([(1, moment)], "source_id bigint, since timestamp")
    for found in (lookups.since(items, 1, moment), lookups.since_each(items, marks)):
        text = found._jdf.queryExecution().executedPlan().toString()
        scan = text.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
        assert "created_part" in scan and ">=" in scan
        assert found.count() == 2


def test_upsert(spark, warehouse):
    warehouse.replace("sources", R.sources(spark, [(1, "a", "A", True), (2, "b", "B", True)]))
    change = "id long, code string, name string, kind string, is_enabled boolean, description string"
    changes = spark.createDataFrame(
        [(1, "a", "A2", "api", False, "d"), (99, "z", "Z", "html", True, None), (None, "n2", "N", "html", True, None), (None, "n1", "N", "html", True, None)],
        change,
    )
    warehouse.replace("sources", upsert_sources(warehouse.current("sources"), changes, NOW))
    now = {r.code: r for r in warehouse.current("sources").collect()}
    assert {c: r.id for c, r in now.items()} == {"a": 1, "b": 2, "z": 99, "n1": 100, "n2": 101}
    assert (now["a"].name, now["a"].kind, now["a"].is_enabled, now["a"].description) == ("A2", "api", False, "d")
    assert now["a"].created_at == now["a"].updated_at == R.T0 and now["z"].created_at == NOW
    twice = spark.createDataFrame([(1, "a", "", "", True, None), (1, "c", "", "", True, None)], change)
    with pytest.raises(ValueError, match="several changes"):
        upsert_sources(warehouse.current("sources"), twice, NOW)
    clash = spark.createDataFrame([(None, "b", "", "", True, None)], change)
    with pytest.raises(ValueError, match="not unique"):
        upsert_sources(warehouse.current("sources"), clash, NOW)


def test_source_lists(spark):
    src = R.sources(spark, [(3, "c", "C", True), (1, "a", "A", False), (2, "b", "B", True)])
    assert [r.id for r in lookups.all_sources(src).collect()] == [1, 2, 3]
    assert [r.id for r in lookups.active_sources(src).collect()] == [2, 3]


def test_since_is_inclusive_and_ordered(spark):
    items = R.raw_items(spark, [(2, 1, "b", "p"), (1, 1, "a", "p"), (3, 2, "c", "p")])
    assert [r.id for r in lookups.since(items, 1, R.T0).collect()] == [1, 2]
    assert lookups.since(items, 1, datetime(2025, 1, 1, 0, 0, 1)).count() == 0


def test_search_pages_cover_everything_once(spark):
    found = R.bids(spark, [{"price_value": None if i % 5 == 0 else Decimal(i % 4)} for i in range(23)])
    seen, after = [], None
    while page := lookups.search(found, [], sort="price_value", page_size=4, after=after).collect():
        seen += [r.id for r in page]
        after = (page[-1].price_value, page[-1].id)
    assert sorted(seen) == list(range(1, 24)) and len(seen) == 23
    with pytest.raises(ValueError):
        lookups.search(found, [], sort="price_value; drop")


def test_config_seed_files(spark, tmp_path):
    (tmp_path / "seed.json").write_text(
        '{"id": 1, "code": "d1", "name": "n", "is_active": true, "data": {"keys": ["a"]},'
        ' "created_at": "2025-01-01T00:00:00", "updated_at": "2025-01-01T00:00:00"}\n'
    )
    row = read_config(spark, str(tmp_path)).first()
    assert json.loads(row.data) == {"keys": ["a"]} and row.created_at == R.T0 and row.is_active


def test_every_declared_table_is_readable(spark, tmp_path):
    assert len(schemas.TABLES) == 12
    for name, schema in schemas.TABLES.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / name))
        assert read_table(spark, str(tmp_path / name), name).columns == schema.fieldNames()


# --- deletes, tombstones, writers against each other ---

ANY = {"c": {"target": "cargo_type", "value": "x", "priority": 1, "keywords": [], "regex": "."}}


def no_places(spark):
    return spark.createDataFrame([], "alias string, place string, region string")


def old_and_new(spark, warehouse):
    """Four raw items with bids, the first two from long before."""
    src = R.sources(spark, [(1, "A", "A", True)])
    items = R.provided(spark, [("A", 0, f"e{i}", f"p{i}") for i in range(4)])
    late = F.col("external_id").isin("e2", "e3")
    items = items.withColumn("created_at", F.when(late, F.col("created_at") + F.expr("interval 30 days")).otherwise(F.col("created_at")))
    assert harvest(warehouse, src, items, R.codes(spark, "A"), "b1", NOW, "idempotent")
    return src, items


def test_reprocessing_after_retention_keeps_bids_without_raw_item(spark, warehouse):
    src, items = old_and_new(spark, warehouse)
    assert warehouse.retain("t1", R.T0 + timedelta(days=10), NOW)
    assert reprocess(warehouse, ["b1"], "r1", src, no_places(spark), configuration(spark, config_classifier=ANY), NOW)
    found = {r.id: (r.raw_item_id, r.cargo_type) for r in warehouse.read("bids").collect()}
    assert found == {1: (None, None), 2: (None, None), 3: (3, "x"), 4: (4, "x")}
    # Dropped items stay dropped.
    assert harvest(warehouse, src, items, R.codes(spark, "A"), "b2", NOW, "idempotent") is False
    assert harvest(warehouse, src, items, R.codes(spark, "A"), "b3", NOW, "append")
    assert warehouse.read("raw_items").count() == 6
    assert reprocess(warehouse, ["r1"], "r2", src, no_places(spark), configuration(spark, config_classifier=ANY), NOW)
    assert sorted(r.id for r in warehouse.read("bids").collect()) == list(range(1, 9))


def test_deletes_write_no_row_anew_and_are_joined_to_their_batches_only(spark, warehouse):
    old_and_new(spark, warehouse)
    raw_of(spark, warehouse, "b2", 3, first=10, days=30)
    assert warehouse.retain("t1", R.T0 + timedelta(days=10), NOW)
    row = warehouse.batches()["t1"]
    assert row["raw_count"] == row["bid_count"] == 0 and [d["n"] for d in row["deletes"]] == [2]
    assert [(r["table"], r["column"], r["batch_id"]) for r in row["releases"]] == [("bids", "raw_item_id", "b1")]
    untouched = warehouse.read("raw_items", batches=["b2"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in untouched and "Join" in warehouse.read("raw_items")._jdf.queryExecution().executedPlan().toString()
    # A batch without rows left is not read at all.
    assert warehouse.delete("t2", "raw_items", warehouse.read("raw_items", batches=["b1"]).select("id"), NOW)
    assert warehouse.visible("raw_items") == ["b2"] and warehouse.read("raw_items").count() == 3
    assert {r.raw_item_id for r in warehouse.read("bids").collect()} == {None, 5, 6, 7}
    assert warehouse.delete("t2", "raw_items", spark.range(9), NOW) is False
    assert warehouse.delete("t3", "raw_items", spark.range(100, 109), NOW) is False


def stored_tables(spark, warehouse):
    """Sources 1 and 2, each with raw items, jobs and errors; bids of source 1 only."""
    src = R.sources(spark, [(1, "A", "A", True), (2, "B", "B", True)])
    warehouse.replace("sources", src)
    raw_of(spark, warehouse, "b1", 2)
    raw = R.raw_items(spark, [(11, 2, "x", "p"), (12, 2, "y", "p")])
    jobs = [(21, 2, "harvest", "done", NOW, NOW, 2, 2, 0, None, NOW), (22, 1, "harvest", "done", NOW, NOW, 2, 2, 0, None, NOW)]
    errors = [(31, 2, 21, NOW, "error", "m", None, NOW), (32, 1, 22, NOW, "error", "m", None, NOW), (33, None, 21, NOW, "error", "m", None, NOW)]
    warehouse.stage("raw_items", "b2", raw)
    warehouse.stage("jobs", "b2", spark.createDataFrame([j[: len(schemas.JOBS)] for j in jobs], schemas.JOBS))
    warehouse.stage("errors", "b2", spark.createDataFrame([e[: len(schemas.ERRORS)] for e in errors], schemas.ERRORS))
    warehouse.commit("b2", NOW)
    return src


def orphans(warehouse):
    from bidflow.operators.integrity import foreign_key_orphans

    tables = {t: warehouse.read(t) for t in ("raw_items", "bids", "jobs", "errors")}
    return foreign_key_orphans({**tables, "sources": warehouse.current("sources")}).count()


def test_a_delete_reaches_every_child_in_one_commit(spark, warehouse):
    src = stored_tables(spark, warehouse)
    before = warehouse.commits.last()
    with pytest.raises(ValueError, match="bids"):
        warehouse.delete_sources("d0", src.select("id"), NOW)
    assert warehouse.commits.last() == before and warehouse.current("sources").count() == 2
    assert warehouse.delete_sources("d1", src.where("id = 2"), NOW)
    assert warehouse.commits.last() == before + 1 and orphans(warehouse) == 0
    assert sorted(r.id for r in warehouse.read("raw_items").collect()) == [1, 2]
    assert {r.id: r.source_id for r in warehouse.read("jobs").collect() if r.id > 20} == {21: None, 22: 1}
    assert {r.id: (r.source_id, r.job_id) for r in warehouse.read("errors").collect()} == {31: (None, 21), 32: (1, 22), 33: (None, 21)}
    assert warehouse.delete("d2", "jobs", spark.createDataFrame([(21,)], "id bigint"), NOW)
    assert {r.id: r.job_id for r in warehouse.read("errors").collect()} == {31: None, 32: 22, 33: None} and orphans(warehouse) == 0
    assert warehouse.delete("d3", "raw_items", spark.createDataFrame([(1,)], "id bigint"), NOW)
    assert {r.id: r.raw_item_id for r in warehouse.read("bids").collect()} == {1: None, 2: 2} and orphans(warehouse) == 0


def writers(spark, warehouse, src, n):
    """Four kinds of work on a warehouse, each under a batch id of its own."""
    items = R.provided(spark, [("A", 0, f"w{n}-{i}", "p") for i in range(2)])
    return {
        "harvest": lambda w: harvest(w, src, items, R.codes(spark, "A"), f"harvest{n}", NOW),
        "reprocess": lambda w: reprocess(w, ["b1"], f"reprocess{n}", src, no_places(spark), configuration(spark, config_classifier=ANY), NOW),
        "retain": lambda w: w.retain(f"retain{n}", R.T0 + timedelta(days=10), NOW),
        "delete": lambda w: w.delete_sources(f"delete{n}", w.current("sources").where("id = 2"), NOW),
    }


KINDS = ["harvest", "reprocess", "retain", "delete"]


@pytest.mark.parametrize(("first", "second"), itertools.combinations_with_replacement(KINDS, 2))
def test_writers_that_meet(spark, tmp_path, monkeypatch, first, second):
    """The second writer does all its work between the work and the commit of the first."""
    warehouse, other = (Warehouse(spark, str(tmp_path / "wh")) for _ in range(2))
    src, _ = old_and_new(spark, warehouse)
    warehouse.replace("sources", R.sources(spark, [(1, "A", "A", True), (2, "B", "B", True)]))
    commit, met = Warehouse.commit, []

    def late(self, *args):
        if self is warehouse and not met:
            met.append(writers(spark, other, src, 2)[second](other))
        return commit(self, *args)

    monkeypatch.setattr(Warehouse, "commit", late)
    done = writers(spark, warehouse, src, 1)[first](warehouse)
    # What the second one has done already leaves nothing to do for a first one of the same kind.
    assert met == [True] and done == (first != second or first in ("harvest", "reprocess"))
    for table in ("raw_items", "bids", "jobs"):
        ids = [r.id for r in warehouse.read(table).collect()]
        assert len(ids) == len(set(ids)), table
    done_kinds = {first, second}
    assert warehouse.read("raw_items").count() == 4 + 2 * [first, second].count("harvest") * 1 - 2 * ("retain" in done_kinds)
    assert warehouse.read("bids").count() == 4 + 2 * [first, second].count("harvest")
    assert warehouse.current("sources").count() == 2 - ("delete" in done_kinds)
    assert other.read("bids").count() == warehouse.read("bids").count()


@pytest.mark.parametrize("kind", KINDS)
def test_a_writer_that_stops_before_its_commit_leaves_nothing(spark, tmp_path, monkeypatch, kind):
    warehouse = Warehouse(spark, str(tmp_path / "wh"))
    src, _ = old_and_new(spark, warehouse)
    warehouse.replace("sources", R.sources(spark, [(1, "A", "A", True), (2, "B", "B", True)]))
    tables = ("raw_items", "bids", "jobs")

    def state():
        return {t: sorted(map(tuple, Warehouse(spark, warehouse.root).read(t).collect())) for t in tables}

    before, claim = state(), type(warehouse.commits)._claim
    monkeypatch.setattr(type(warehouse.commits), "_claim", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        writers(spark, warehouse, src, 1)[kind](warehouse)
    assert state() == before and warehouse.current("sources").count() == 2
    monkeypatch.setattr(type(warehouse.commits), "_claim", claim)
    assert writers(spark, warehouse, src, 1)[kind](warehouse)


def test_a_number_is_given_once(spark, tmp_path):
    from bidflow.plans.commits import Commits, Conflict

    one, two = (Commits(spark, str(tmp_path), log_files=2) for _ in range(2))
    assert one.add(0, {"batch_id": "a"}) == 1
    with pytest.raises(Conflict, match="'b'"):
        two.add(0, {"batch_id": "b"})
    assert two.add(two.last(), {"batch_id": "b", "committed_at": NOW}) == 2
    for i in range(3):
        one.add(one.last(), {"batch_id": f"c{i}"})
    fresh = Commits(spark, str(tmp_path))
    assert [r["batch_id"] for r in fresh.rows()] == [r["batch_id"] for r in one.rows()] == ["a", "b", "c0", "c1", "c2"]
    assert sorted(r.number for r in fresh.frame().collect()) == [1, 2, 3, 4, 5]
    assert fresh.rows()[1]["committed_at"] == NOW
    # Numbers below a snapshot are taken too.
    with pytest.raises(Conflict):
        fresh.add(1, {"batch_id": "late"})


def test_changes_of_a_small_table_meet(spark, tmp_path):
    one, two = (Warehouse(spark, str(tmp_path / "wh")) for _ in range(2))
    one.replace("sources", R.sources(spark, [(1, "A", "A", True)]))
    done = []

    def add(warehouse, i):
        def make(rows):
            if warehouse is one and not done:
                done.append(add(two, 3))
            return rows.unionByName(R.sources(spark, [(i, f"s{i}", "S", True)]))

        return warehouse.change("sources", make)

    add(one, 2)
    assert sorted(r.id for r in two.current("sources").collect()) == [1, 2, 3]


def test_bad_rows_become_errors_of_their_jobs(spark, warehouse):
    src = R.sources(spark, [(1, "a", "A", True), (2, "b", "B", True), (3, "c", "C", True)])
    rows = R.provided(spark, [("a", 0, "x", "p"), ("a", 0, "y", ""), ("b", 0, None, ""), ("b", 0, "u" * 300, "p"), ("b", 0, "z", "")])
    rows = rows.withColumn("payload", F.nullif("payload", F.lit("")))
    later = NOW + timedelta(seconds=40)
    args = (src, rows, src.select("code"))
    assert harvest_with_outcomes(warehouse, *args, "b1", NOW, "idempotent", clock=lambda: later)
    assert not harvest_with_outcomes(warehouse, *args, "b1", NOW)
    jobs = {r.source_id: r for r in warehouse.read("jobs").collect()}
    found = {s: (r.status, r.items_total, r.items_created, r.error_message) for s, r in jobs.items()}
    assert found == {1: ("done", 2, 1, "1 of 2 rows rejected"), 2: ("failed", 3, 0, "3 of 3 rows rejected"), 3: ("done", 0, 0, None)}
    assert {(r.started_at, r.finished_at) for r in jobs.values()} == {(NOW, later)}
    assert [r.external_id for r in warehouse.read("raw_items").collect()] == ["x"]
    errors = warehouse.read("errors").orderBy("id").collect()
    assert [r.id for r in errors] == [1, 2, 3, 4] and {r.severity for r in errors} == {"error"}
    assert all(r.job_id == jobs[r.source_id].id for r in errors)
    assert [(r.source_id, r.message) for r in errors] == [
        (1, "payload is missing"), (2, "external_id is longer than 128"), (2, "payload is missing"), (2, "payload is missing"),
    ]
    assert json.loads(errors[2].details) == {} and json.loads(errors[3].details)["external_id"] == "z"
    # Nothing new: no items, yet the runs and their errors are told.
    assert harvest_with_outcomes(warehouse, *args, "b2", later, "idempotent")
    assert warehouse.read("raw_items").count() == 1 and warehouse.read("bids").count() == 1
    assert sorted(r.id for r in warehouse.read("jobs").collect()) == [1, 2, 3, 4, 5, 6]
    assert sorted(r.id for r in warehouse.read("errors").collect()) == list(range(1, 9))


def test_outcomes_of_no_rows(spark, warehouse):
    src = R.sources(spark, [(1, "a", "A", True)])
    none = R.provided(spark, [])
    assert harvest_with_outcomes(warehouse, src, none, src.select("code"), "b1", NOW)
    job = warehouse.read("jobs").collect()
    assert [(r.source_id, r.status, r.items_total) for r in job] == [(1, "done", 0)]
    assert warehouse.read("errors").count() == 0 and warehouse.visible("raw_items") == []
    assert not harvest_with_outcomes(warehouse, src, none, src.where("false").select("code"), "b2", NOW)
    with pytest.raises(ValueError, match="not found"):
        harvest_with_outcomes(warehouse, src, none, spark.createDataFrame([("q",)], "code string"), "b3", NOW)


def test_shuffles_of_a_batch_and_what_refining_writes_go(spark, warehouse, tmp_path, monkeypatch):
    from bidflow import shared

    def shuffled():
        return len(list(Path(spark.sparkContext._jvm.System.getProperty("java.io.tmpdir")).glob("blockmgr-*/*/shuffle_*.data")))

    src = raw_of(spark, warehouse, "b1", 4)
    before = shuffled()
    warehouse.stage("bids", "b2", warehouse.read("bids").repartition(7))
    for _ in range(50):
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before
    assert list(tmp_path.rglob("bids/**/*.zstd.parquet"))
    # When the new bids are written, what refining has written is gone.
    monkeypatch.setattr(shared, "shared_dir", lambda _: str(tmp_path / "between"))
    seen, stage = [], Warehouse.stage

    def watched(self, table, *more, **options):
        seen.append((table, {p.name.split("-")[0] for p in (tmp_path / "between" / "bidflow").iterdir()}))
        return stage(self, table, *more, **options)

    monkeypatch.setattr(Warehouse, "stage", watched)
    assert reprocess(warehouse, ["b1"], "r1", src, no_places(spark), configuration(spark, config_classifier=ANY), NOW)
    assert seen[0][0] == "bids" and "rebuilt" in seen[0][1] and not seen[0][1] & {"judged", "groups"}
    assert [r.id for r in warehouse.read("bids").orderBy("id").collect()] == [1, 2, 3, 4]
