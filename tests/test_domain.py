import re
from datetime import datetime

from pyspark.sql.types import StructField, StructType

from bidflow import shared
from bidflow.checks.domain import Domain
from bidflow.schemas import TABLES

COUNT, SIZE = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def test_sized_bounds_the_rows_of_a_task(spark, monkeypatch):
    monkeypatch.setattr(shared, "ROWS_PER_TASK", 100)
    before = {key: spark.conf.get(key) for key in (COUNT, SIZE)}
    with shared.sized(spark, 4_050):
        assert spark.conf.get(COUNT) == "41"
        assert spark.conf.get(SIZE) == shared.SIZED_BYTES
    assert {key: spark.conf.get(key) for key in (COUNT, SIZE)} == before
    with shared.sized(spark, 90):
        assert {key: spark.conf.get(key) for key in (COUNT, SIZE)} == before


def test_bids_are_made_in_tasks_of_bounded_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "ROWS_PER_TASK", 100)
    spark.range(4_050).write.parquet(f"{tmp_path}/lineitem.parquet")
    seen = []

    def bids(self):
        seen.append(spark.conf.get(COUNT))
        return spark.createDataFrame([], TABLES["bids"])

    monkeypatch.setattr(Domain, "_bids", bids)
    assert Domain(spark, str(tmp_path)).bids.count() == 0
    assert seen == ["41"]


def test_names_of_places_are_not_shuffled_with_the_lines(spark, tmp_path):
    """Bids of two lines, one without an order: joins go from numbers to names, and the rows are right."""
    day = "timestamp '1996-03-13'"
    tables = {
        "region": "select 0 as r_regionkey, 'ASIA' as r_name",
        "nation": "select * from values (1, 'CHINA', 0), (2, 'INDIA', 0) as t(n_nationkey, n_name, n_regionkey)",
        "customer": "select 30L as c_custkey, 'C30' as c_name, 2 as c_nationkey",
        "supplier": "select 7L as s_suppkey, 1 as s_nationkey",
        "part": "select 9L as p_partkey, 'tin' as p_name, 'SMALL' as p_type, 'B1' as p_brand",
        "orders": f"select 5L as o_orderkey, 30L as o_custkey, {day} as o_orderdate, '1-URGENT' as o_orderpriority",
        "lineitem": f"""select k as l_orderkey, 9L as l_partkey, 7L as l_suppkey, n as l_linenumber, 2.0D as l_quantity,
          3.5D as l_extendedprice, 0D as l_discount, 0D as l_tax, f as l_returnflag, s as l_linestatus, {day} as l_shipdate
          from values (4L, 1, 'N', 'O'), (5L, 1, 'R', 'F'), (5L, 2, 'N', 'O'), (5L, 3, null, null) as t(k, n, f, s)""",
    }
    for name, sql in tables.items():
        spark.sql(sql).write.parquet(f"{tmp_path}/{name}.parquet")
    d = Domain(spark, str(tmp_path))
    joins = re.findall(r"Join Inner, \((.*)\)", d._bids()._jdf.queryExecution().optimizedPlan().toString())
    assert all("nationkey" in on for on in joins[:2]) and "l_orderkey" in " ".join(joins[2:])
    got = d.bids.orderBy("id").collect()
    shown = [(r.id, r.raw_item_id, r.description, r.price_currency, r.load_location, r.unload_region, r.source_id) for r in got]
    assert shown == [
        (2, None, None, "USD", "CHINA", "ASIA", 8),
        (3, 10, "tin, small", "USD", "CHINA", "ASIA", 8),
        (4, None, None, "USD", "CHINA", "ASIA", 8),
    ]


def test_rows_that_are_read_once_are_not_written_first(spark, tmp_path, monkeypatch):
    """As derived, with the types of the table, until somebody has stored them; then as stored."""
    spark.range(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    made = []

    def errors(self):
        made.append("errors")
        rows = "1 as id, 2 as source_id, null as job_id, 'error' as severity, 'm' as message, null as details"
        times = "timestamp '2024-01-01' as occurred_at, timestamp '2024-01-01' as created_at"
        return spark.sql(f"select {rows}, {times}")

    monkeypatch.setattr(Domain, "_errors", errors)
    written = []
    monkeypatch.setattr(Domain, "_write", lambda self, name, *rest, was=Domain._write: (written.append(name), was(self, name, *rest)))
    d = Domain(spark, str(tmp_path))
    first = d.once("errors")
    assert [(f.name, f.dataType) for f in first.schema] == [(f.name, f.dataType) for f in TABLES["errors"]]
    assert [r.id for r in first.collect()] == [1] and written == []
    assert d.errors.collect() == first.collect() and written == ["errors"]
    assert d.once("errors").collect() == first.collect()
    assert written == ["errors"] and made == ["errors"] * 2


def test_deletes_of_stored_rows_write_them_to_the_warehouse_alone(spark, monkeypatch):
    """Neither raw items nor bids are stored on the way to the warehouse."""
    from bidflow.checks import storing

    rows = {
        "raw_items": [{"id": i, "source_id": 1, "payload": "p", "status": "new"} for i in (4, 5, 6)],
        "bids": [{"id": i, "source_id": 1, "raw_item_id": i, "title": "t", "is_duplicate": False} for i in (4, 5, 7)],
        "jobs": [{"id": i, "source_id": 1, "job_type": "harvest", "status": "done"} for i in (3, 4)],
        "errors": [{"id": i, "source_id": 1, "job_id": i, "severity": "error", "message": "m"} for i in (3, 4)],
    }
    day = datetime(2024, 1, 1)
    times = {f: day for f in ("created_at", "updated_at", "fetched_at", "occurred_at")}

    def table(name):
        schema = StructType([StructField(f.name, f.dataType) for f in TABLES[name]])
        return spark.createDataFrame([tuple((times | r).get(f.name) for f in schema) for r in rows[name]], schema)

    for name in rows:
        monkeypatch.setattr(Domain, f"_{name}", lambda self, name=name: table(name))
    monkeypatch.setattr(Domain, "given", lambda self, name: spark.range(1))
    written = []
    monkeypatch.setattr(Domain, "_write", lambda self, name, *rest, was=Domain._write: (written.append(name), was(self, name, *rest)))
    got = storing.deletes_of_stored_rows(Domain(spark, "deletes"))
    assert sorted(map(tuple, got.collect())) == [
        ("bids", 4, 4), ("bids", 5, None), ("bids", 7, 7), ("errors", 3, None), ("errors", 4, 4),
        ("jobs", 4, 1), ("raw_items", 4, 1), ("raw_items", 6, 1),
    ]
    assert written == []
