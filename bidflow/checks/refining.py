"""Queries: parsing, normalizing, classifying, filtering, near duplicates, the whole refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidflow.checks import config
from bidflow.checks.domain import Domain, with_tables
from bidflow.checks.registry import dbl, query, ts
from bidflow.functions import text, values
from bidflow.operators import classify as classifying
from bidflow.operators import mapping, near, rules
from bidflow.operators.ids import with_dense_ids
from bidflow.plans.harvest import bids_of, number_raw, prepare
from bidflow.plans.refine import refine
from bidflow.shared import staged
from bidflow.sources import providers

# --- pages ---

DECODED = r"""replace(replace(replace(replace({}, '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&')"""
SHOWN = r"""regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'),
  '<script\b[^>]*>.*?</script\s*>', ' ', 'gis'), '<style\b[^>]*>.*?</style\s*>', ' ', 'gis')"""


def squeezed(sql: str) -> str:
    return rf"trim(regexp_replace({sql}, '\s+', ' ', 'g'))"


TITLE = squeezed(DECODED.format(r"regexp_extract(html, '<title\b[^>]*>(.*?)</title\s*>', 1, 'is')"))
BODY = squeezed(
    DECODED.format(rf"regexp_replace(regexp_replace({SHOWN}, '<head\b.*?</head\s*>', ' ', 'gis'), '<[a-zA-Z/!][^>]*>', ' ', 'gs')")
)


@query(f"select page_id, nullif({TITLE}, '') as title from pages")
def page_titles(d: Domain) -> DataFrame:
    return d.given("pages").select("page_id", text.html_title(F.col("html")).alias("title"))


@query(f"select page_id, {BODY} as body from pages")
def page_text(d: Domain) -> DataFrame:
    return d.given("pages").select("page_id", text.html_text(F.col("html")).alias("body"))


@query(rf"""select page_id, unnest(regexp_extract_all({SHOWN}, '<a\b[^>]*?\bhref\s*=\s*"([^"]*)"', 1, 'is')) as link,
  generate_subscripts(regexp_extract_all({SHOWN}, '<a\b[^>]*?\bhref\s*=\s*"([^"]*)"', 1, 'is'), 1) - 1 as pos from pages""")
def page_links(d: Domain) -> DataFrame:
    links = text.html_links(F.col("html"))
    return d.given("pages").select("page_id", F.posexplode(links).alias("pos", "link"))


# --- normalizers: typed values are written out the way people do, then read back ---


@query("""select o_orderkey, strftime(o_orderdate + case o_orderkey % 8 when 4 then interval '3 hours 7 minutes'
  when 5 then interval '4 hours 45 minutes' when 6 then interval 3 hour when 7 then interval 5 hour - interval 3 day
  else interval 0 hour end, '%Y-%m-%d %H:%M:%S.%f') as read_at from orders""")
def dates(d: Domain) -> DataFrame:
    when, n = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % 8
    written = (
        F.when(n == 0, F.date_format(when, "dd.MM.yyyy"))
        .when(n == 1, F.date_format(when, "yyyy-MM-dd"))
        .when(n == 2, F.date_format(when, " yyyy-MM-dd'T'HH:mm:ss "))
        .when(n == 3, F.lit("Сегодня"))
        .when(n == 5, F.lit("15 минут назад"))
        .when(n == 6, F.lit("2 часа  назад"))
        .when(n == 7, F.lit("3 Days ago"))
        .otherwise(F.concat(F.lit("вчера, в "), F.date_format(when + F.expr("interval '3:07' hour to minute"), "HH:mm")))
    )
    received = when + F.when(n == 4, F.expr("interval '1 5' day to hour")).otherwise(F.expr("interval '0 5' day to hour"))
    texts = d.given("orders").select("o_orderkey", values.clean(written).alias("text"), received.alias("received"))
    return texts.select("o_orderkey", values.moment(F.col("text"), F.col("received")).alias("read_at"))


@query("""select l_orderkey, l_linenumber, l_shipdate is not null as dated,
    cast(cast(l_extendedprice as decimal(14,2)) as double) as price,
    case l_linenumber % 3 when 0 then 'RUB' when 1 then 'USD' else null end as currency,
    cast(cast(l_quantity as decimal(14,3)) as double) as tons
  from lineitem""")
def prices_and_weights(d: Domain) -> DataFrame:
    n = F.col("l_linenumber") % 3
    amount = F.translate(F.format_number(F.col("l_extendedprice").cast("decimal(14,2)"), 2), ",.", " ,")
    price = (
        F.when(n == 0, F.concat(amount, F.lit(" руб.")))
        .when(n == 1, F.concat(F.lit("$"), F.col("l_extendedprice").cast("decimal(14,2)").cast("string")))
        .otherwise(F.concat(F.lit("цена "), amount))
    )
    tons = F.col("l_quantity").cast("decimal(14,3)")
    weight = (
        F.when(n == 0, F.concat(F.translate(tons.cast("string"), ".", ","), F.lit(" т")))
        .when(n == 1, F.concat((tons * 1000).cast("decimal(14,0)").cast("string"), F.lit(" кг")))
        .otherwise(F.concat(F.lit("вес "), tons.cast("string"), F.lit("тонн")))
    )
    texts = d.given("lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_shipdate").isNotNull().alias("dated"),
        values.clean(price).alias("price"), values.clean(weight).alias("weight"),
    )
    return texts.select(
        "l_orderkey", "l_linenumber", "dated", values.price(F.col("price")).alias("price"),
        values.currency(F.col("price")).alias("currency"), values.weight_tons(F.col("weight")).alias("tons"),
    )


@query("""select l_orderkey, l_linenumber, cast(cast(l_extendedprice as decimal(14,2)) as double) as price,
    cast(cast(l_quantity + 1 as decimal(14,3)) as double) as tons from lineitem""")
def spelled_amounts(d: Domain) -> DataFrame:
    """Prices in thousands and millions, ranges, and weights as ranges."""
    n, price = F.col("l_linenumber") % 4, F.col("l_extendedprice").cast("decimal(14,2)")
    thousands = F.translate((price / 1000).cast("decimal(14,5)").cast("string"), ".", ",")
    written = (
        F.when(n == 0, F.concat(thousands, F.lit(" тыс. руб")))
        .when(n == 1, F.concat(F.lit("от "), (price / 1_000_000).cast("decimal(14,8)").cast("string"), F.lit(" млн")))
        .when(n == 2, F.concat(thousands, F.lit(" т.р.")))
        .otherwise(F.concat(price.cast("string"), F.lit("–"), (price + 500).cast("string"), F.lit(" руб")))
    )
    low, high = F.col("l_quantity").cast("int"), (F.col("l_quantity") + 1).cast("int")
    weight = (
        F.when(n == 0, F.concat(low, F.lit("-"), high, F.lit(" т")))
        .when(n == 1, F.concat((low * 1000).cast("string"), F.lit(" - "), (high * 1000).cast("string"), F.lit(" кг")))
        .otherwise(F.concat((high / 1000).cast("decimal(14,6)").cast("string"), F.lit(" тыс. т")))
    )
    texts = d.given("lineitem").select(
        "l_orderkey", "l_linenumber", values.clean(written).alias("price"), values.clean(weight).alias("weight")
    )
    return texts.select(
        "l_orderkey", "l_linenumber", values.price(F.col("price")).alias("price"), values.weight_tons(F.col("weight")).alias("tons")
    )


@query("""select o_orderkey, strftime(cast(o_orderdate as timestamp) + case o_orderkey % 7 when 0 then interval '10 hours 15 minutes'
    when 1 then interval '7 hours 15 minutes' when 2 then interval '10 hours 15 minutes' when 4 then interval '1 day 8 hours'
    when 5 then interval '4 hours 5 minutes' when 6 then interval '4 hours 35 minutes' else interval 0 hour end,
  '%Y-%m-%d %H:%M:%S.%f') as read_at from orders""")
def spelled_dates(d: Domain) -> DataFrame:
    """ISO times with zones, times without seconds, named months, tomorrow, and spans without a number."""
    when, n = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % 7
    months = F.array(*[F.lit(m) for m in "января февраля марта апреля мая июня июля августа сентября октября ноября декабря".split()])
    named = F.concat_ws(" ", F.dayofmonth(when).cast("string"), F.get(months, F.month(when) - 1), F.year(when).cast("string"), F.lit("г."))
    written = (
        F.when(n == 0, F.date_format(when, "yyyy-MM-dd'T10:15:00Z'"))
        .when(n == 1, F.date_format(when, "yyyy-MM-dd'T10:15:00.000+03:00'"))
        .when(n == 2, F.date_format(when, "yyyy-MM-dd 10:15"))
        .when(n == 3, named)
        .when(n == 4, F.lit("Завтра в 08:00"))
        .when(n == 5, F.lit("час назад"))
        .otherwise(F.lit("полчаса назад"))
    )
    received = when + F.expr("interval '5:05' hour to minute")
    texts = d.given("orders").select("o_orderkey", values.clean(written).alias("text"), received.alias("received"))
    return texts.select("o_orderkey", values.moment(F.col("text"), F.col("received")).alias("read_at"))


@query("""select c_custkey, case when c_custkey % 4 = 3 then null else '+79' || lpad(cast(c_custkey as varchar), 9, '0') end as phone
  from customer""")
def phones(d: Domain) -> DataFrame:
    digits = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    parts = [F.substring(digits, 1, 2), F.substring(digits, 3, 3), F.substring(digits, 6, 2), F.substring(digits, 8, 2)]
    n = F.col("c_custkey") % 4
    written = (
        F.when(n == 0, F.concat(F.lit("8 (9"), parts[0], F.lit(") "), F.concat_ws("-", *parts[1:])))
        .when(n == 1, F.concat(F.lit("+7 9"), F.concat_ws(" ", *parts)))
        .when(n == 2, F.concat(F.lit("9"), digits))
        .otherwise(F.concat(F.lit("доб. "), parts[0]))
    )
    return d.given("customer").select("c_custkey", values.phone(written).alias("phone"))


@query(r"""select doc_id, nullif('+' || regexp_replace(regexp_extract(text,
    '(?:\+\d{1,3}|\b[78])[\s(-]{1,2}\d{3}[\s)-]{1,2}\d{3}[\s-]?\d{2}[\s-]?\d{2}\b'), '[^0-9]', '', 'g'), '+') as phone
  from documents""")
def text_phones(d: Domain) -> DataFrame:
    """First phone in the whole text of every document."""
    return d.given("documents").select("doc_id", values.first_phone(F.col("text")).alias("phone"))


def places(d: Domain) -> DataFrame:
    """Place dictionary: nation names, an alias each, and their regions."""
    named = d.given("nation").join(d.given("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    place, region = F.col("n_name").alias("place"), F.col("r_name").alias("region")
    plain = named.select(values.place_key(F.col("n_name")).alias("alias"), place, region)
    short = named.select(F.concat(F.lit("n"), "n_nationkey").alias("alias"), place, region)
    return plain.unionAll(short)


@query(f"""{with_tables('bids')} select id, load_location, load_region, case when id % 10 = 9 then 'Elsewhere' else unload_location end
  as unload_location, case when id % 10 <> 9 then unload_region end as unload_region from bids""")
def routes(d: Domain) -> DataFrame:
    from bidflow.plans.refine import locate

    near_name = F.lower(F.replace("load_location", F.lit("_"), F.lit(" ")))
    far = F.when(F.col("id") % 10 == 9, "Elsewhere").otherwise(F.replace("unload_location", F.lit("NATION_"), F.lit("n")))
    dash = F.when(F.col("id") % 2 == 0, F.lit(" — ")).otherwise(F.lit(" - "))
    written = d.bids.select("id", F.concat(F.lit("г. "), near_name, dash, far).alias("route"))
    ends = written.select("id", values.route_places(F.col("route")).alias("places")).select(
        "id", F.element_at("places", 1).alias("load_location"), F.element_at("places", -1).alias("unload_location")
    )
    known = places(d)
    return locate(locate(ends, known, "load_location", "load_region"), known, "unload_location", "unload_region").select(
        "id", "load_location", "load_region", "unload_location", "unload_region"
    )


# --- classify and filter ---

CLASS = r"""case when regexp_matches(t, '(^|\W)hot\s+bolt(\W|$)') or list_has_any(w, ['plate']) then 'special'
  when list_has_any(w, ['bolt', 'rod']) then 'fasteners' when list_has_any(w, ['gear', 'anvil']) then 'machines'
  when regexp_matches(t, 'widget|gizmo') then 'goods' end"""
TRANSPORT = r"""case when list_has_any(w, ['red', 'hot']) then 'tipper' when regexp_matches(t, '(?i)\bsmall\b') then 'flatbed' end"""
WORDS = r"""concat_ws(' ', title, coalesce(description, '')) as t,
  regexp_extract_all(lower(concat_ws(' ', title, coalesce(description, ''))), '\w+(?:-\w+)*') as w"""


@query(f"""{with_tables('bids')} select id, title, {CLASS} as cargo_type,
  case when load_location = unload_location then transport_type else {TRANSPORT} end as transport_type
  from (select *, {WORDS} from bids)""")
def classify(d: Domain) -> DataFrame:
    """Cargo types anew; transport types only where none is given."""
    blank = F.when(F.col("load_location") == F.col("unload_location"), F.col("transport_type"))
    bids = d.bids.withColumn("cargo_type", F.lit(None).cast("string")).withColumn("transport_type", blank)
    return classifying.classify(bids, config.classifiers(d.spark)).select("id", "title", "cargo_type", "transport_type")


REASONS = r"""list_filter([
    case when coalesce(cargo_type, '') = '' then 'cargo_type_missing' end,
    case when source_id in (select id from sources where code in ('src1', 'src12'))
      and not coalesce(weight_value between 10 and 50, false) then 'heavy_only' end,
    case when coalesce(load_region in ('AFRICA'), false) then 'no_africa' end,
    case when regexp_matches(title, '(^|\W)(blue\s+bolt|anvil)(\W|$)', 'i') then 'no_blue_bolt' end,
    case when regexp_matches(title, '^hot .*gear$') then 'no_widget_end' end,
    case when not coalesce(price_value >= 20000, false) then 'price_floor' end], lambda x: x is not null)"""


@query(f"""{with_tables('sources', 'bids')}, partly as (select * exclude (cargo_type),
    case when load_location <> unload_location then cargo_type end as cargo_type from bids)
  select id, array_to_string({REASONS}, ',') as reasons, len({REASONS}) = 0 as kept from partly""")
def filter_rules(d: Domain) -> DataFrame:
    """Every bid with the rules it fails."""
    some = d.bids.withColumn("cargo_type", F.when(F.col("load_location") != F.col("unload_location"), F.col("cargo_type")))
    judged = rules.filter_bids(some, config.filter_rules(d.spark), d.sources)
    return judged.select("id", F.array_join("reasons", ",").alias("reasons"), (F.size("reasons") == 0).alias("kept"))


# --- the whole refinement: bids are written out as a feed of JSON payloads and refined back ---


def feed(b: DataFrame) -> DataFrame:
    """Raw items of an API feed that says in words what the bids ``b`` hold; it landed within a week."""
    landed_at = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=(F.col("id") % 10080).cast("int"))
    amount = F.translate(F.format_number("price_value", 2), ",.", " ,")
    money = F.when(F.col("price_currency") == "USD", F.concat(F.lit("$ "), F.col("price_value").cast("string"))).otherwise(
        F.concat(amount, F.lit(" руб"))
    )
    payload = F.to_json(
        F.struct(
            F.col("title"),
            F.col("description"),
            F.concat_ws(" - ", "load_location", F.lower(F.replace("unload_location", F.lit("_"), F.lit(" ")))).alias("route"),
            F.concat(F.translate(F.col("weight_value").cast("string"), ".", ","), F.lit(" т")).alias("weight"),
            money.alias("price"),
            F.concat(F.lit("8 "), F.substring("contact_phone", 3, 10)).alias("phone"),
            F.col("contact_name").alias("contact"),
            F.date_format("published_at", "dd.MM.yyyy HH:mm").alias("published"),
        )
    )
    return b.select(
        "id", "source_id", "external_id", "url", F.col("created_at").alias("fetched_at"), payload.alias("payload"),
        F.lit("new").alias("status"), F.lit(None).cast("string").alias("error_message"),
        F.lit(None).cast("string").alias("hash"), landed_at.alias("created_at"),
    )


def configs(d: Domain) -> dict[str, DataFrame]:
    return {
        "config_classifier": config.classifiers(d.spark),
        "config_filter_rule": config.filter_rules(d.spark),
        "config_dedup": config.dedup_rules(d.spark),
    }


@query(rf"""{with_tables('sources', 'bids')}, typed as (select * exclude (cargo_type, transport_type), {CLASS} as cargo_type,
    {TRANSPORT} as transport_type from (select *, {WORDS} from bids)),
  judged as (select *, {REASONS} as reasons from typed),
  marked as (select *, row_number() over (partition by source_id, external_id order by id) > 1 as dup
    from judged where len(reasons) = 0)
  select id, source_id, external_id, title, description, cargo_type, transport_type, {dbl('weight_value')}, 't' as weight_unit,
    {dbl('price_value')}, price_currency, load_location, unload_location, load_region, unload_region,
    {ts('published_at')}, contact_name, substring(contact_phone, 1, 12) as contact_phone, dup as is_duplicate
  from marked""")
def refined_bids(d: Domain) -> DataFrame:
    """Parse, normalize, classify, filter and mark duplicates over the whole feed."""
    out = refine(feed(d.bids), d.sources, places(d), configs(d), config.NOW)
    return out.select(
        "id", "source_id", "external_id", "title", "description", "cargo_type", "transport_type", "weight_value",
        "weight_unit", "price_value", "price_currency", "load_location", "unload_location", "load_region",
        "unload_region", "published_at", "contact_name", "contact_phone", "is_duplicate",
    )


ANY_CARGO = {"text": {"target": "cargo_type", "value": "text", "priority": 1, "keywords": [], "regex": "."}}
PHONE_RUN = r"""'(?:\+\d{1,3}|\b[78])[\s(-]{1,2}\d{3}[\s)-]{1,2}\d{3}[\s-]?\d{2}[\s-]?\d{2}\b'"""


def _refined_texts(d: Domain, rows: DataFrame, number: Column, kind: str) -> DataFrame:
    """Landed rows of a kind through the whole refinement, all under source 1."""
    at = F.lit("2024-01-01").cast("timestamp")
    items = providers.READERS[kind](rows, F.lit("any"), at).withColumn("source_id", F.lit(1).cast("bigint"))
    raw = mapping.raw_from_entity(with_dense_ids(items, ["external_id"]))
    any_config = {
        "config_classifier": config.config(d.spark, ANY_CARGO),
        "config_filter_rule": config.config(d.spark, {}),
        "config_dedup": config.dedup_rules(d.spark),
    }
    out = refine(raw, d.sources, places(d), any_config, config.NOW)
    return out.select("external_id", "url", "title", "description", "cargo_type", "contact_phone", "is_duplicate")


@query(rf"""{with_tables('sources')}, read as (select page_id, url, {TITLE} as title, {BODY} as body from pages)
  select 'page-' || page_id as external_id, url,
    coalesce(nullif(title, ''), (select trim(coalesce(nullif(name, ''), code) || ': заявка page-' || page_id) from sources where id = 1)) as title,
    body as description, case when title || body <> '' then 'text' end as cargo_type,
    nullif('+' || regexp_replace(regexp_extract(body, {{PHONE_RUN}}), '[^0-9]', '', 'g'), '+') as contact_phone,
    false as is_duplicate from read""".replace("{PHONE_RUN}", PHONE_RUN))
def refined_pages(d: Domain) -> DataFrame:
    """Web pages through the whole refinement: title, visible text and phone."""
    return _refined_texts(d, d.given("pages"), F.col("page_id"), "html")


@query(rf"""{with_tables('sources')} select 'msg-' || conv_id || '-' || turn as external_id, cast(null as varchar) as url,
    (select trim(coalesce(nullif(name, ''), code) || ': заявка msg-' || conv_id || '-' || turn) from sources where id = 1) as title,
    text as description, 'text' as cargo_type,
    nullif('+' || regexp_replace(regexp_extract(text, {{PHONE_RUN}}), '[^0-9]', '', 'g'), '+') as contact_phone,
    false as is_duplicate from conversations""".replace("{PHONE_RUN}", PHONE_RUN))
def refined_messages(d: Domain) -> DataFrame:
    """Chat messages through the whole refinement: their text and the phone in it."""
    return _refined_texts(d, d.given("conversations"), F.concat_ws("-", "conv_id", "turn"), "telegram")


def _near_sql() -> str:
    from bidflow.checks.storing import LANDED, numbered

    word = r"[\p{L}\p{M}\p{N}_]+(?:-[\p{L}\p{M}\p{N}_]+)*"
    # Whole pairs here: similar texts, then everything that links of such reach.
    return rf"""{LANDED.replace('with ', 'with recursive ', 1)}, bid as (select id, payload from {numbered('landed')}),
  w as (select id, regexp_extract_all(lower(payload), '{word}') as words from bid),
  t as (select min(id) as id, words from w group by words),
  sh as (select distinct id, array_to_string(words[i:i + 2], ' ') as s
    from (select id, words, unnest(range(1, greatest(len(words) - 2, 1) + 1)) as i from t)),
  n as (select id, count(*) as n from sh group by id),
  common as (select a.id as x, b.id as y, count(*) as c from sh a join sh b on a.s = b.s and a.id < b.id group by a.id, b.id),
  link as (select x, y from common join n nx on nx.id = x join n ny on ny.id = y where c / (nx.n + ny.n - c) >= 0.8),
  both_ways as (select x, y from link union all select y, x from link),
  reach(id, other) as (select id, id from t union select r.id, l.y from reach r join both_ways l on l.x = r.other),
  g as (select id, min(other) as group_id from reach group by id)
  select w.id, g.group_id, w.id <> g.group_id as is_near_duplicate
  from w join t on t.words = w.words join g on g.id = t.id"""


def near_duplicates(d: Domain) -> DataFrame:
    """Near-duplicate groups among the bids harvested from all documents."""
    from bidflow.checks.storing import landed

    codes = d.sources.select("code")
    bids = staged(bids_of(number_raw(prepare(landed(d), d.sources, codes), after=0), config.NOW, 0), "harvested")
    return near.near_duplicates(bids)
