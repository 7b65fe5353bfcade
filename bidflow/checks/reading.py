"""Queries: mappings, lookups, search, joins along references, integrity."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidflow.checks import config
from bidflow.checks.domain import Domain, with_tables
from bidflow.checks.registry import dbl, query, ts
from bidflow.functions.keys import content_hash, dedup_key
from bidflow.functions.text import bid_title, json_field
from bidflow.operators import dedup, evolve, integrity, lookups, mapping, rules

SOURCE_COLS = f"id, code, name, kind, is_enabled, description, {ts('created_at', 'updated_at')}"
RAW_ENTITY = f"id, source_id, external_id, payload, url, {ts('created_at')}, {ts('fetched_at')[:-len('fetched_at')]}received_at"
BID_ENTITY = f"""id, source_id, raw_item_id, external_id, title, coalesce(description, '') as description,
  cargo_type, transport_type, load_location as load_point, unload_location as unload_point,
  cast(weight_value as double) as weight_tons, cast(price_value as double) as price, price_currency as currency,
  contact_phone as contact, url, {ts('published_at', 'created_at')}"""
BID_ROW = f"""id, source_id, raw_item_id, external_id, title, description, cargo_type, transport_type,
  {dbl('weight_value')}, weight_unit, {dbl('price_value')}, price_currency, load_location, unload_location,
  load_region, unload_region, {ts('published_at', 'received_at')}, contact_name, contact_phone, contact_email,
  url, dedup_key, is_duplicate, {ts('created_at', 'updated_at')}"""


@query(f"{with_tables('sources', 'raw_items', 'bids', 'jobs', 'errors')}"
       + " union all ".join(
           f" select '{t}' as table_name, count(*) as n_rows, min(id) as first_id, max(id) as last_id from {t}"
           for t in ("sources", "raw_items", "bids", "jobs", "errors"))
       + "".join(f" union all select '{t}', count(*), min(id), max(id) from sources" for t in ("config_source", "config_schedule"))
       + "".join(f" union all select '{t}', {len(c)}, 1, {len(c)}" for t, c in config.CODES.items()))
def table_scan(d: Domain) -> DataFrame:
    """Typed scan of all twelve tables."""
    out = None
    for name, df in d.all_tables().items():
        row = df.agg(
            F.lit(name).alias("table_name"), F.count("*").alias("n_rows"),
            F.min("id").alias("first_id"), F.max("id").alias("last_id"),
        )
        out = row if out is None else out.unionAll(row)
    return out


# --- mappings ---


@query(f"""{with_tables('sources')} select id, code, name, kind, is_enabled as is_active,
  coalesce(description, '') as description from sources""")
def sources_as_entities(d: Domain) -> DataFrame:
    return mapping.source_to_entity(d.sources)


@query(f"{with_tables('raw_items')} select {RAW_ENTITY} from raw_items")
def raw_as_entities(d: Domain) -> DataFrame:
    return mapping.raw_to_entity(d.raw_items)


@query(f"""{with_tables('raw_items')} select id, source_id, external_id, url, {ts('fetched_at')}, payload,
  'new' as status, error_message, hash, {ts('created_at')} from raw_items""")
def raw_from_entities(d: Domain) -> DataFrame:
    return mapping.raw_from_entity(mapping.raw_to_entity(d.raw_items))


@query(f"{with_tables('bids')} select {BID_ENTITY} from bids")
def bid_to_entity(d: Domain) -> DataFrame:
    return mapping.bid_to_entity(d.bids)


@query(f"""{with_tables('bids')}, stripped as (
  select id, source_id, raw_item_id, external_id, title, coalesce(description, '') as description, cargo_type,
    transport_type, load_location, unload_location, price_value, price_currency, contact_phone, url, published_at,
    case when load_location <> unload_location then weight_value end as weight_value,
    case when load_location <> unload_location then 't' end as weight_unit,
    cast(null as varchar) as load_region, cast(null as varchar) as unload_region,
    cast(null as timestamp) as received_at, cast(null as varchar) as contact_name,
    cast(null as varchar) as contact_email, cast(null as varchar) as dedup_key, false as is_duplicate,
    created_at, created_at as updated_at
  from bids) select {BID_ROW} from stripped""")
def entity_to_bid(d: Domain) -> DataFrame:
    entities = mapping.bid_to_entity(d.bids)
    weight = F.when(F.col("load_point") != F.col("unload_point"), F.col("weight_tons"))
    return mapping.bid_from_entity(entities.withColumn("weight_tons", weight))


@query(f"""{with_tables('sources', 'raw_items')}
  select r.id, trim(coalesce(nullif(s.name, ''), s.code) || ': заявка ' ||
    coalesce(nullif(r.external_id, ''), cast(nullif(r.id, 0) as varchar), '')) as title
  from raw_items r join sources s on r.source_id = s.id""")
def bid_titles(d: Domain) -> DataFrame:
    src = d.sources.select(F.col("id").alias("source_id"), "name", "code")
    title = bid_title(F.col("name"), F.col("code"), F.col("external_id"), F.col("id"))
    return d.raw_items.select("id", "source_id", "external_id").join(src, "source_id").select("id", title.alias("title"))


@query("""select event_id, props as payload, cast(json_extract_string(props, '$.k') as bigint) as k from events
  union all select 1000000000 + doc_id, text, null from documents""")
def payload_json(d: Domain) -> DataFrame:
    """JSON payloads give fields, any other payload gives NULL."""
    both = d.given("events").select("event_id", F.col("props").alias("payload")).unionAll(
        d.given("documents").select((F.col("doc_id") + 1000000000).alias("event_id"), F.col("text").alias("payload"))
    )
    return both.select("event_id", "payload", json_field(F.col("payload"), "k").cast("bigint").alias("k"))


V1 = """select id, code, name, kind as type, is_enabled, id % 3 as priority, 'https://' || code as base_url,
  created_at, updated_at from sources"""


def _v1(d: Domain) -> DataFrame:
    return d.sources.selectExpr(
        "id", "code", "name", "kind as type", "is_enabled", "id % 3 as priority",
        "concat('https://', code) as base_url", "created_at", "updated_at",
    )


@query(f"""{with_tables('sources')} select id, code, name, kind, is_enabled, cast(null as varchar) as description,
  {ts('created_at', 'updated_at')} from ({V1.replace('kind as type', 'kind')})""")
def sources_v1_to_v3(d: Domain) -> DataFrame:
    return evolve.sources_v2_to_v3(evolve.sources_v1_to_v2(_v1(d)))


@query(f"""{with_tables('sources')} select id, code, name, kind as type, is_enabled, cast(0 as bigint) as priority,
  cast(null as varchar) as base_url, {ts('created_at', 'updated_at')} from sources""")
def sources_v3_to_v1(d: Domain) -> DataFrame:
    return evolve.sources_v2_to_v1(evolve.sources_v3_to_v2(d.sources))


@query(f"{with_tables('raw_items')} select id, sha256(payload) as hash from raw_items")
def content_hashes(d: Domain) -> DataFrame:
    return d.raw_items.select("id", content_hash(F.col("payload")).alias("hash"))


@query(f"""{with_tables('bids')} select id, sha256('{{"source_id":' || source_id || ',"title":"' || lower(title) || '"}}')
  as dedup_key from bids""")
def dedup_keys(d: Domain) -> DataFrame:
    return d.bids.select("id", dedup_key(d.bids, ["source_id", "title"]).alias("dedup_key"))


# --- lookups ---


@query(f"{with_tables('sources', 'jobs')} select {SOURCE_COLS} from sources where id in (select source_id from jobs)")
def lookup_sources(d: Domain) -> DataFrame:
    return lookups.by_ids(d.sources, d.jobs.select(F.col("source_id").alias("id")))


@query(f"""{with_tables('raw_items', 'bids')} select id, source_id, external_id, {ts('created_at')} from raw_items
  where id in (select raw_item_id from bids where raw_item_id is not null)""")
def lookup_raw_items(d: Domain) -> DataFrame:
    found = lookups.by_ids(d.raw_items, d.bids.select(F.col("raw_item_id").alias("id")))
    return found.select("id", "source_id", "external_id", "created_at")


@query(f"""{with_tables('bids', 'errors')} select id, source_id, external_id, title from bids
  where id in (select id from errors)""")
def lookup_bids(d: Domain) -> DataFrame:
    return lookups.by_ids(d.bids, d.errors).select("id", "source_id", "external_id", "title")


@query(f"{with_tables('bids')} select id, source_id, external_id, title from bids where id = 42")
def bid_by_id(d: Domain) -> DataFrame:
    return lookups.by_id(d.bids, 42).select("id", "source_id", "external_id", "title")


@query(f"{with_tables('sources')} select {SOURCE_COLS} from sources where code = 'src3'")
def source_by_code(d: Domain) -> DataFrame:
    return lookups.source_by_code(d.sources, "src3")


@query(f"""{with_tables('sources')} select {SOURCE_COLS} from sources
  where code in (select source from documents where lang = 'de')""")
def sources_by_codes(d: Domain) -> DataFrame:
    codes = d.given("documents").where("lang = 'de'").select(F.col("source").alias("code"))
    return lookups.sources_by_codes(d.sources, codes)


@query(f"{with_tables('sources')} select {SOURCE_COLS} from sources order by id")
def sources_all(d: Domain) -> DataFrame:
    return lookups.all_sources(d.sources)


@query(f"{with_tables('sources')} select {SOURCE_COLS} from sources where is_enabled order by id")
def sources_active(d: Domain) -> DataFrame:
    return lookups.active_sources(d.sources)


@query(f"""{with_tables('raw_items')} select {RAW_ENTITY} from raw_items
  where source_id = 3 and created_at >= timestamp '2024-01-01 02:00:00'""")
def raw_since(d: Domain) -> DataFrame:
    return mapping.raw_to_entity(lookups.since(d.raw_items, 3, datetime(2024, 1, 1, 2)))


@query(f"""{with_tables('bids')} select {BID_ENTITY} from bids
  where source_id = 3 and created_at >= timestamp '1999-06-01 00:00:00'""")
def bids_since(d: Domain) -> DataFrame:
    return mapping.bid_to_entity(lookups.since(d.bids_by_year, 3, datetime(1999, 6, 1), "year"))


@query(f"""{with_tables('sources', 'raw_items')} select r.id, r.source_id, {ts('r.created_at').replace('as r.', 'as ')}
  from raw_items r join sources s on r.source_id = s.id
  where s.is_enabled and r.created_at >= timestamp '2024-01-01' + to_minutes(10 * s.id)""")
def raw_since_each(d: Domain) -> DataFrame:
    marks = d.sources.where("is_enabled").selectExpr(
        "id as source_id", "timestamp '2024-01-01' + make_dt_interval(0, 0, int(10 * id)) as since"
    )
    return lookups.since_each(d.raw_items.select("id", "source_id", "created_at"), marks)


@query(f"""{with_tables('sources', 'bids')} select b.id, b.source_id, {ts('b.created_at').replace('as b.', 'as ')}
  from bids b join sources s on b.source_id = s.id
  where b.created_at >= timestamp '1997-01-01' + to_days(cast(60 * s.id as integer))""")
def bids_since_each(d: Domain) -> DataFrame:
    marks = d.sources.selectExpr("id as source_id", "timestamp '1997-01-01' + make_dt_interval(int(60 * id)) as since")
    return lookups.since_each(d.bids_by_year.select("id", "source_id", "created_at", "created_part"), marks, "year")


@query(f"""{with_tables('sources')} select distinct 'src' || (conv_id % 25) as code from conversations
  where 'src' || (conv_id % 25) not in (select code from sources)""")
def missing_codes(d: Domain) -> DataFrame:
    """Codes the messages were tagged with that name no source."""
    codes = d.given("conversations").select(F.concat(F.lit("src"), F.col("conv_id") % 25).alias("code"))
    return lookups.missing_codes(codes, d.sources)


SEARCH = "cargo_type = 'PROMO' and load_region = unload_region and price_value >= 20000"
FOUND = f"id, title, load_region, {dbl('price_value')}"


def _search(d: Domain, after=None) -> DataFrame:
    conditions = [
        F.col("cargo_type") == "PROMO",
        F.col("load_region") == F.col("unload_region"),
        F.col("price_value") >= 20000,
    ]
    page = lookups.search(d.bids, conditions, sort="price_value", page_size=50, after=after)
    return page.select("id", "title", "load_region", "price_value")


@query(f"""{with_tables('bids')} select {FOUND} from (select * from bids where {SEARCH}
  order by bids.price_value desc, id desc limit 50)""")
def search_bids(d: Domain) -> DataFrame:
    return _search(d)


@query(f"""{with_tables('bids')} select {FOUND} from (select * from bids where {SEARCH}
  order by bids.price_value desc, id desc limit 50 offset 50)""")
def search_bids_next(d: Domain) -> DataFrame:
    """The page after the first, reached from the first page's last row."""
    rows = _search(d).orderBy("price_value", "id").limit(1).collect()
    return _search(d, after=(rows[0]["price_value"], rows[0]["id"])) if rows else _search(d)


CUTOFF = datetime(2024, 1, 1, 6)


@query(f"""{with_tables('raw_items')} select id, source_id, {ts('created_at')} from raw_items
  where created_at >= timestamp '2024-01-01 06:00:00'""")
def retention_raw(d: Domain) -> DataFrame:
    return integrity.retention(d.raw_items, d.bids, CUTOFF)[0].select("id", "source_id", "created_at")


@query(f"""{with_tables('raw_items', 'bids')} select id, case when raw_item_id not in
  (select id from raw_items where created_at < timestamp '2024-01-01 06:00:00') then raw_item_id end as raw_item_id
  from bids""")
def retention_bids(d: Domain) -> DataFrame:
    return integrity.retention(d.raw_items, d.bids.select("id", "raw_item_id"), CUTOFF)[1]


WORDS = ["the", "und", "de la"]


@query(r"""select conv_id, turn, text from conversations
  where regexp_matches(text, '(^|[^\p{L}\p{N}_])(the|und|de\s+la)([^\p{L}\p{N}_]|$)', 'i')""")
def message_keywords(d: Domain) -> DataFrame:
    return rules.bid_messages(d.given("conversations"), WORDS).select("conv_id", "turn", "text")


# --- joins along references ---


@query(f"""{with_tables('sources', 'raw_items', 'bids')}
  select b.id, b.source_id, b.raw_item_id, b.external_id, r.id as raw_id, r.external_id as raw_external_id,
    strftime(r.fetched_at, '%Y-%m-%d %H:%M:%S.%f') as raw_fetched_at, r.status as raw_status,
    s.code as source_code, s.kind as source_kind
  from bids b join sources s on s.id = b.source_id left join raw_items r on r.id = b.raw_item_id""")
def bid_lineage(d: Domain) -> DataFrame:
    return integrity.bid_lineage(d.bids, d.raw_items, d.sources)


@query(f"""{with_tables('sources', 'jobs', 'errors')}
  select e.id, e.source_id, e.job_id, e.severity, e.message, j.job_type as job_job_type, j.status as job_status,
    s.code as source_code
  from errors e left join jobs j on j.id = e.job_id left join sources s on s.id = e.source_id""")
def error_lineage(d: Domain) -> DataFrame:
    return integrity.error_lineage(d.errors, d.jobs, d.sources)


@query(f"""{with_tables('bids')} select id, source_id, external_id,
  count(*) over (partition by source_id, external_id) as n_candidates,
  min(id) over (partition by source_id, external_id) as first_id from bids""")
def duplicate_candidates(d: Domain) -> DataFrame:
    return dedup.duplicate_candidates(d.bids).drop("key")


@query(f"""{with_tables('raw_items')} select id, source_id, external_id,
  count(*) over (partition by source_id, external_id) as n_candidates,
  min(id) over (partition by source_id, external_id) as first_id from raw_items""")
def duplicate_candidates_with_nulls(d: Domain) -> DataFrame:
    """The same over rows a third of whose external ids may be NULL: NULL equals NULL."""
    return dedup.duplicate_candidates(d.raw_items).drop("key")


@query(f"""{with_tables('bids')} select source_id, external_id, count(*) as n_bids, min(id) as first_id
  from bids group by source_id, external_id""")
def duplicate_groups(d: Domain) -> DataFrame:
    return dedup.duplicate_groups(d.bids)


@query(f"""{with_tables('bids')} select id, source_id, external_id, cargo_type from bids b
  where exists (select 1 from bids p where p.cargo_type = 'PROMO' and p.source_id = b.source_id
    and p.external_id is not distinct from b.external_id)""")
def candidates_of_probes(d: Domain) -> DataFrame:
    """Stored bids sharing source and external id with any PROMO bid."""
    probes = d.bids.where("cargo_type = 'PROMO'")
    return dedup.candidates_of(d.bids.select("id", "source_id", "external_id", "cargo_type"), probes).drop("key")


def _orphans_sql() -> str:
    from bidflow.schemas import FOREIGN_KEYS

    return " union all ".join(
        f"select '{c}.{k}' as reference, id as child_id, {k} as parent_id from {c} "
        f"where {k} is not null and {k} not in (select id from {p})"
        for c, k, p, _ in FOREIGN_KEYS
    )


@query(f"{with_tables('sources', 'raw_items', 'bids', 'jobs', 'errors')} {_orphans_sql()}")
def foreign_key_orphans(d: Domain) -> DataFrame:
    return integrity.foreign_key_orphans(d.tables())


@query(f"""{with_tables('sources', 'raw_items', 'bids', 'jobs', 'errors')}, gone as (select id from sources where not is_enabled)
  select 'raw_items.source_id' as reference, 'deleted' as effect, id as child_id from raw_items where source_id in (select id from gone)
  union all select 'bids.raw_item_id', 'set_null', id from bids
    where raw_item_id in (select id from raw_items where source_id in (select id from gone))
  union all select 'bids.source_id', 'blocked', id from bids where source_id in (select id from gone)
  union all select 'jobs.source_id', 'set_null', id from jobs where source_id in (select id from gone)
  union all select 'errors.source_id', 'set_null', id from errors where source_id in (select id from gone)""")
def delete_effects(d: Domain) -> DataFrame:
    """What deleting the inactive sources would do."""
    return integrity.delete_effects(d.tables(), "sources", d.sources.where(~F.col("is_enabled")))


@query(f"""{with_tables('sources', 'raw_items', 'bids')}, gone as (select id from raw_items where url is null)
  select id, case when raw_item_id in (select id from gone) then null else raw_item_id end as raw_item_id from bids""")
def released_bids(d: Domain) -> DataFrame:
    """Bids after the raw items without an address were deleted."""
    gone = d.raw_items.where(F.col("url").isNull())
    return integrity.release(d.bids.select("id", "raw_item_id"), "raw_item_id", gone)


def _audit_sql() -> str:
    from bidflow.schemas import DOMAINS, MAX_LENGTHS, TABLES

    parts = []
    for t in TABLES:
        for f in TABLES[t]:
            if not f.nullable:
                parts.append(f"select '{t}' as table_name, '{f.name}' as column_name, 'not_null' as rule, "
                             f"count(*) filter ({f.name} is null) as violations from {t}")
        for c, allowed in DOMAINS.get(t, {}).items():
            values = ", ".join(f"'{v}'" for v in allowed)
            parts.append(f"select '{t}', '{c}', 'domain', count(*) filter ({c} not in ({values})) from {t}")
        for c, n in MAX_LENGTHS[t].items():
            parts.append(f"select '{t}', '{c}', 'max_length', count(*) filter (length({c}) > {n}) from {t}")
        if t == "sources" or t.startswith("config_"):
            parts.append(f"select '{t}', 'code', 'unique', count(*) from "
                         f"(select code from {t} group by code having count(*) > 1)")
    return " union all ".join(parts)


def _config_sql() -> str:
    columns = "name, created_at, updated_at, true as is_active, '{}' as data"
    derived = [f"{t} as (select id, code, {columns} from sources)" for t in ("config_source", "config_schedule")]
    for t, codes in config.CODES.items():
        listed = ", ".join(f"({i}, '{c}', '{c}')" for i, c in enumerate(codes, 1))
        at = "timestamp '2025-12-03 10:15:00' as created_at, timestamp '2025-12-03 10:15:00' as updated_at"
        derived.append(f"{t} as (select *, {at}, true as is_active, '{{}}' as data from (values {listed}) as v(id, code, name))")
    return ", ".join(derived)


@query(f"{with_tables('sources', 'raw_items', 'bids', 'jobs', 'errors')}, {_config_sql()} {_audit_sql()}")
def constraint_audit(d: Domain) -> DataFrame:
    return integrity.constraint_audit(d.all_tables())


# --- duplicates ---

MARKED = "id, source_id, external_id, is_duplicate"


@query(f"""{with_tables('bids')} select id, source_id, external_id,
  row_number() over (partition by source_id, external_id order by created_at, id) > 1 as is_duplicate from bids""")
def mark_duplicates(d: Domain) -> DataFrame:
    marked = dedup.mark_duplicates(d.bids, ["source_id", "external_id"])
    return marked.select("id", "source_id", "external_id", "is_duplicate")


@query(f"""{with_tables('bids')} select id, source_id, external_id, row_number() over (partition by title, contact_phone,
  load_location, cast(floor(date_diff('day', date '1970-01-01', cast(created_at as date)) / 30.0) as bigint)
  order by created_at desc, id desc) > 1 or (contact_phone is not null and row_number() over (
  partition by source_id, contact_phone, title order by created_at, id) > 1) as is_duplicate from bids""")
def dedup_configured(d: Domain) -> DataFrame:
    """Two strategies: title, phone and loading place within 30-day windows, missing phones equal, the last stays;
    and source, phone and title, the first stays."""
    marked = dedup.mark_by_all(d.bids, rules.active_config(config.config(d.spark, config.DEDUP_TWICE)))
    return marked.select("id", "source_id", "external_id", "is_duplicate")


@query(f"""{with_tables('raw_items')} select sha256(payload) as hash, strlen(payload) as n_bytes, count(*) as n_items,
  min(id) as first_id from raw_items group by payload having count(*) > 1""")
def payload_duplicates(d: Domain) -> DataFrame:
    return dedup.payload_duplicates(d.raw_items)
