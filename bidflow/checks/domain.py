"""The domain tables, derived from the given tables, as DataFrames and as SQL.

``Domain`` loads the given parquet files, derives sources, raw_items, bids, jobs
and errors with the library's own operators, and stores them once per session as
written tables: queries then read what a user would read, pruned parquet. ``SQL``
states the same derivations for a second engine.
"""

from __future__ import annotations

from contextlib import AbstractContextManager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidflow import schemas
from bidflow.operators.ids import with_dense_ids
from bidflow.shared import COMPRESSION, cleared, new_path, shuffles_gone, sized, staged
from bidflow.sources.tables import read_table

LINE_ORDER = (
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)

# Expressions that read the same in both engines, one per line.
SOURCES_BODY = """
    case when id % 4 = 0 then '' else concat(case when id % 7 = 0 then '  ' else '' end, 'Feed ', code) end as name,
    case id % 3 when 0 then 'html' when 1 then 'telegram' else 'api' end as kind,
    id % 5 <> 0 as is_enabled,
    case when id % 2 = 1 then concat('Landed documents of ', code) end as description,
    cast('2024-01-01 00:00:00' as timestamp) as created_at,
    cast('2024-01-01 00:00:00' as timestamp) as updated_at
"""

JOBS_BODY = """
    event_id + 1 as id,
    case when user_id % 7 = 0 then null else 1 + user_id % 21 end as source_id,
    case when event_type in ('view', 'click') then 'reprocess' else 'harvest' end as job_type,
    case when event_type = 'error' then 'failed' else 'done' end as status
"""

SQL = {
    "sources": f"""
sources as (
  select id, code, {SOURCES_BODY}
  from (select row_number() over (order by code) as id, code from (select distinct source as code from documents))
)""",
    "raw_items": """
raw_items as (
  select d.doc_id + 1 as id, s.id as source_id,
    case when (d.doc_id // 20) % 10 = 0 then null else 'ext-' || ((d.doc_id // 20) % 23) end as external_id,
    case when d.lang <> 'en' then 'https://' || d.source || '.example/' || d.doc_id end as url,
    cast('2024-01-01 00:05:00' as timestamp) + to_minutes(d.doc_id) as fetched_at,
    d.text as payload, 'new' as status, cast(null as varchar) as error_message, cast(null as varchar) as hash,
    cast('2024-01-01 00:00:00' as timestamp) + to_minutes(d.doc_id) as created_at
  from documents d join sources s on s.code = d.source
)""",
    "bids": """
bids as (
  select l.id, 1 + l_suppkey % 20 as source_id,
    case when l_returnflag = 'R' then null else 1 + l_partkey end as raw_item_id,
    l_orderkey || '-' || l_linenumber as external_id,
    p_name as title,
    case when l_linestatus = 'O' then p_name || ', ' || lower(p_type) end as description,
    p_type as cargo_type, p_brand as transport_type,
    cast(l_quantity as decimal(14,3)) as weight_value, 't' as weight_unit,
    cast(l_extendedprice as decimal(14,2)) as price_value,
    case when o_orderpriority = '1-URGENT' then 'USD' else 'RUB' end as price_currency,
    sn.n_name as load_location, cn.n_name as unload_location,
    sr.r_name as load_region, cr.r_name as unload_region,
    o_orderdate as published_at, cast(null as timestamp) as received_at,
    c_name as contact_name,
    case when c_custkey % 3 = 0 then null else '+79' || lpad(cast(c_custkey as varchar), 9, '0') end as contact_phone,
    cast(null as varchar) as contact_email,
    'https://bids.example/' || l_orderkey as url, cast(null as varchar) as dedup_key, false as is_duplicate,
    l_shipdate as created_at, l_shipdate as updated_at
  from (select *, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
          l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as id from lineitem) l
  join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
  join supplier on l_suppkey = s_suppkey join nation sn on s_nationkey = sn.n_nationkey
  join region sr on sn.n_regionkey = sr.r_regionkey
  join customer on o_custkey = c_custkey join nation cn on c_nationkey = cn.n_nationkey
  join region cr on cn.n_regionkey = cr.r_regionkey
)""",
    "jobs": f"""
jobs as (
  select {JOBS_BODY}, ts as started_at,
    make_timestamp(epoch_us(ts) + cast(round(value * 1000000) as bigint)) as finished_at,
    cast(json_extract_string(props, '$.k') as integer) as items_total,
    cast(json_extract_string(props, '$.k') as integer) as items_created, 0 as items_updated,
    case when event_type = 'error' then 'run failed' end as error_message, ts as created_at
  from events
)""",
    "errors": """
errors as (
  select event_id + 1 as id,
    case when user_id % 7 = 0 then null else 1 + user_id % 21 end as source_id,
    case when event_id % 6 = 0 then null else event_id + 1 end as job_id,
    ts as occurred_at, case when value > 60 then 'critical' else 'error' end as severity,
    'run failed' as message, props as details, ts as created_at
  from events where event_type = 'error'
)""",
}

# Tables each derivation reads.
NEEDS = {"raw_items": ["sources"], "bids": [], "jobs": [], "errors": [], "sources": []}

_stored: dict[tuple[str, str], str] = {}


class Domain:
    """Given and derived tables of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _table(self, name: str, partitioned: bool = False) -> DataFrame:
        """A derived table, written on first use in this application."""
        key = (self.spark.sparkContext.applicationId, f"{self.dir}/{name}")
        if key not in _stored:
            path = new_path(self.spark, name)
            # What it is made of by way of written tables goes once it is written.
            with self.sized(name), cleared(self.spark), shuffles_gone(self.spark):
                self._write(name, path, partitioned)
            _stored[key] = path
        return read_table(self.spark, _stored[key], name, partitioned)

    def sized(self, name: str) -> AbstractContextManager[None]:
        """Around the work that derives a table: bids are shuffled by every table they are made of, the others only meet the sources."""
        return sized(self.spark, self.given("lineitem").count() if name == "bids" else 0)

    def once(self, name: str) -> DataFrame:
        """A derived table for work that reads all of it one time: as written if it is, and not written for this otherwise."""
        if (self.spark.sparkContext.applicationId, f"{self.dir}/{name}") in _stored:
            return getattr(self, name)
        return self._derived(name)

    def _derived(self, name: str) -> DataFrame:
        rows = getattr(self, f"_{name}")().select(*schemas.TABLES[name].fieldNames())
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.TABLES[name]])

    def _write(self, name: str, path: str, partitioned: bool) -> None:
        rows = self._derived(name)
        writer = rows.write
        if partitioned:
            # Ship dates span years: one folder per year keeps the folders few.
            parted = rows.withColumn("created_part", F.to_date(F.date_trunc("year", "created_at")))
            writer = parted.sortWithinPartitions("created_part", "source_id", "created_at").write
            writer = writer.partitionBy("created_part")
        writer.option("compression", COMPRESSION).parquet(path)

    @property
    def sources(self) -> DataFrame:
        return self._table("sources")

    @property
    def raw_items(self) -> DataFrame:
        return self._table("raw_items")

    @property
    def bids(self) -> DataFrame:
        return self.bids_by_year.drop("created_part")

    @property
    def bids_by_year(self) -> DataFrame:
        return self._table("bids", partitioned=True)

    @property
    def jobs(self) -> DataFrame:
        return self._table("jobs")

    @property
    def errors(self) -> DataFrame:
        return self._table("errors")

    def tables(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in ("sources", "raw_items", "bids", "jobs", "errors")}

    def all_tables(self) -> dict[str, DataFrame]:
        """All twelve, with the configurations the queries use."""
        from bidflow.checks import config, reporting

        return {
            **self.tables(),
            "config_source": reporting.settings(self),
            "config_filter_rule": config.filter_rules(self.spark),
            "config_classifier": config.classifiers(self.spark),
            "config_dedup": config.dedup_rules(self.spark),
            "config_schedule": reporting.schedules(self),
            "config_antibot": config.antibot(self.spark),
            "config_export": config.exports(self.spark),
        }

    # --- derivations ---

    def _sources(self) -> DataFrame:
        codes = self.given("documents").select(F.col("source").alias("code")).distinct()
        return with_dense_ids(codes, ["code"]).selectExpr("id", "code", *self._aliases(SOURCES_BODY))

    def _raw_items(self) -> DataFrame:
        minutes = F.make_dt_interval(F.lit(0), F.lit(0), F.col("doc_id").cast("int"))
        k = F.floor(F.col("doc_id") / 20)
        start = F.lit("2024-01-01 00:00:00").cast("timestamp")
        source = self.sources.select(F.col("id").alias("source_id"), F.col("code").alias("source"))
        return (
            self.given("documents")
            .join(source, "source")
            .select(
                (F.col("doc_id") + 1).alias("id"),
                "source_id",
                F.when(k % 10 != 0, F.concat(F.lit("ext-"), k % 23)).alias("external_id"),
                F.when(F.col("lang") != "en", F.concat(F.lit("https://"), "source", F.lit(".example/"), "doc_id")).alias("url"),
                (start + minutes + F.expr("interval 5 minutes")).alias("fetched_at"),
                F.col("text").alias("payload"),
                F.lit("new").alias("status"),
                F.lit(None).cast("string").alias("error_message"),
                F.lit(None).cast("string").alias("hash"),
                (start + minutes).alias("created_at"),
            )
        )

    def numbered_lines(self) -> DataFrame:
        """Line items with dense ids over all their columns."""
        return with_dense_ids(self.given("lineitem"), LINE_ORDER, on_files=True)

    def _bids(self) -> DataFrame:
        """Lines are shuffled as numbers, flags and dates; names of places come last, from a table small enough to be sent around."""
        nation = staged(
            self.given("nation").join(self.given("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select("n_nationkey", "n_name", "r_name"),
            "places",
        )
        load = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("load_location"), F.col("r_name").alias("load_region"))
        unload = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("unload_location"), F.col("r_name").alias("unload_region"))
        customer = self.given("customer").select("c_custkey", "c_nationkey", "c_name")
        orders = (
            self.given("orders")
            .select("o_orderkey", "o_custkey", "o_orderdate", (F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
            .join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .drop("o_custkey")
        )
        lines = (
            self.numbered_lines()
            .select(
                "id", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate",
                (F.col("l_returnflag") != "R").alias("linked"),
                (F.col("l_linestatus") == "O").alias("described"),
            )
            .join(self.given("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
            .drop("s_suppkey")
            .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .drop("o_orderkey")
            .join(self.given("part").select("p_partkey", "p_name", "p_type", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
            .join(load, "s_nationkey")
            .join(unload, "c_nationkey")
        )
        text, phone = F.lit(None).cast("string"), F.concat(F.lit("+79"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
        return lines.select(
            "id",
            (F.col("l_suppkey") % 20 + 1).alias("source_id"),
            F.when(F.col("linked"), F.col("l_partkey") + 1).alias("raw_item_id"),
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("external_id"),
            F.col("p_name").alias("title"),
            F.when(F.col("described"), F.concat("p_name", F.lit(", "), F.lower("p_type"))).alias("description"),
            F.col("p_type").alias("cargo_type"),
            F.col("p_brand").alias("transport_type"),
            F.col("l_quantity").alias("weight_value"),
            F.lit("t").alias("weight_unit"),
            F.col("l_extendedprice").alias("price_value"),
            F.when(F.col("urgent"), "USD").otherwise("RUB").alias("price_currency"),
            "load_location", "unload_location", "load_region", "unload_region",
            F.col("o_orderdate").alias("published_at"),
            text.alias("received_at"),
            F.col("c_name").alias("contact_name"),
            F.when(F.col("c_custkey") % 3 != 0, phone).alias("contact_phone"),
            text.alias("contact_email"),
            F.concat(F.lit("https://bids.example/"), "l_orderkey").alias("url"),
            text.alias("dedup_key"),
            F.lit(False).alias("is_duplicate"),
            F.col("l_shipdate").alias("created_at"),
            F.col("l_shipdate").alias("updated_at"),
        )

    def _jobs(self) -> DataFrame:
        ts = F.col("ts").cast("timestamp")
        items = F.get_json_object("props", "$.k").cast("int")
        return self.given("events").select(
            *[F.expr(e) for e in self._aliases(JOBS_BODY)],
            ts.alias("started_at"),
            F.timestamp_micros(F.unix_micros(ts) + F.round(F.col("value") * 1000000).cast("bigint")).alias("finished_at"),
            items.alias("items_total"),
            items.alias("items_created"),
            F.lit(0).alias("items_updated"),
            F.when(F.col("event_type") == "error", "run failed").alias("error_message"),
            ts.alias("created_at"),
        )

    @staticmethod
    def _aliases(body: str) -> list[str]:
        return [line.strip().rstrip(",") for line in body.strip().splitlines()]

    def _errors(self) -> DataFrame:
        ts = F.col("ts").cast("timestamp")
        return self.given("events").where("event_type = 'error'").select(
            (F.col("event_id") + 1).alias("id"),
            F.when(F.col("user_id") % 7 != 0, F.col("user_id") % 21 + 1).alias("source_id"),
            F.when(F.col("event_id") % 6 != 0, F.col("event_id") + 1).alias("job_id"),
            ts.alias("occurred_at"),
            F.when(F.col("value") > 60, "critical").otherwise("error").alias("severity"),
            F.lit("run failed").alias("message"),
            F.col("props").alias("details"),
            ts.alias("created_at"),
        )


def with_tables(*names: str) -> str:
    """``with`` clause deriving the named tables and what they need."""
    order = [n for n in ("sources", "raw_items", "bids", "jobs", "errors")
             if n in names or any(n in NEEDS[m] for m in names)]
    return "with " + ",".join(SQL[n] for n in order)
