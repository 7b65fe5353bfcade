"""Queries: counters, statistics, shares, alerts, schedules, health."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidflow.checks.domain import Domain, with_tables
from bidflow.checks.registry import day, query
from bidflow.operators import dedup, reports, schedule
from bidflow.plans.health import health_report

AS_OF = datetime(2024, 1, 20)


@query(f"""{with_tables('raw_items', 'bids', 'errors')}, facts as (
    select cast(created_at as date) as d, source_id, 1 as r, 0 as b, 0 as e from raw_items
    union all select cast(created_at as date), source_id, 0, 1, 0 from bids
    union all select cast(occurred_at as date), source_id, 0, 0, 1 from errors)
  select {day('d', 'day')}, source_id, cast(grouping(d, source_id) as bigint) as level,
    cast(sum(r) as bigint) as raw_items, cast(sum(b) as bigint) as bids, cast(sum(e) as bigint) as errors
  from facts group by grouping sets ((d, source_id), (d), ())""")
def daily_stats(d: Domain) -> DataFrame:
    return reports.daily_stats(d.raw_items, d.bids, d.errors)


@query(f"""{with_tables('bids')} select source_id, count(*) as bids, count(*) / sum(count(*)) over () as share
  from bids group by source_id""")
def source_share(d: Domain) -> DataFrame:
    return reports.source_share(d.bids)


@query(f"""{with_tables('bids')}, marked as (select cast(created_at as date) as d, source_id,
    row_number() over (partition by source_id, external_id order by created_at, id) > 1 as dup from bids)
  select {day('d', 'day')}, source_id, count(*) as bids, count(*) filter (dup) as duplicates
  from marked group by d, source_id""")
def duplicate_counts(d: Domain) -> DataFrame:
    return reports.duplicate_counts(dedup.mark_duplicates(d.bids, ["source_id", "external_id"]))


@query(f"""{with_tables('errors')} select severity, source_id, {day('dd', 'day')}, level, errors, jobs from (
  select severity, source_id, cast(occurred_at as date) as dd,
    cast(grouping(severity, source_id, cast(occurred_at as date)) as bigint) as level,
    count(*) as errors, count(job_id) as jobs
  from errors group by rollup (severity, source_id, cast(occurred_at as date)))""")
def error_rollup(d: Domain) -> DataFrame:
    return reports.error_rollup(d.errors)


@query(f"""{with_tables('errors')} select job_id, count(*) as errors,
  strftime(min(occurred_at), '%Y-%m-%d %H:%M:%S.%f') as first_at,
  strftime(max(occurred_at), '%Y-%m-%d %H:%M:%S.%f') as last_at
  from errors where job_id is not null group by job_id""")
def errors_by_job(d: Domain) -> DataFrame:
    return reports.errors_by_job(d.errors)


@query(f"""{with_tables('sources', 'bids')} select s.id as source_id, s.code,
  strftime(last_bid_at, '%Y-%m-%d %H:%M:%S.%f') as last_bid_at
  from sources s left join (select source_id, max(created_at) as last_bid_at from bids group by source_id) b
    on b.source_id = s.id
  where s.is_enabled and (last_bid_at is null or last_bid_at < (select max(created_at) from bids) - interval 12 hour)""")
def silent_sources(d: Domain) -> DataFrame:
    """Sources without a bid in the 12 hours before the last bid of all."""
    as_of = d.bids.agg(F.max("created_at")).first()[0]
    return reports.silent_sources(d.sources, d.bids, as_of, 12)


DURATIONS = f"""{with_tables('jobs')}, runs as (
    select id, source_id, started_at, epoch_us(finished_at) - epoch_us(started_at) as duration_us from jobs),
  timed as (select *, count(*) over w as previous_runs, sum(duration_us) over w / nullif(count(*) over w, 0) as mean_us
    from runs window w as (partition by source_id order by started_at, id rows between 10 preceding and 1 preceding))"""
TIMED = """select id, source_id, strftime(started_at, '%Y-%m-%d %H:%M:%S.%f') as started_at, duration_us,
  previous_runs, mean_us from timed"""


@query(f"{DURATIONS} {TIMED}")
def job_durations(d: Domain) -> DataFrame:
    return reports.job_durations(d.jobs)


@query(f"{DURATIONS} {TIMED} where previous_runs >= 3 and duration_us > mean_us * 2")
def slow_jobs(d: Domain) -> DataFrame:
    return reports.slow_jobs(reports.job_durations(d.jobs))


def schedules(d: Domain) -> DataFrame:
    """One schedule per source except every seventh, derived from the source ids."""
    text = F.to_json(
        F.struct(
            F.col("code").alias("source_code"),
            (F.col("id") * 30).cast("int").alias("interval_minutes"),
            F.lit(2.0).alias("backoff_factor"),
            F.lit(720).alias("max_backoff_minutes"),
        )
    )
    return _config(d, text, F.col("id") % 7 != 0)


def settings(d: Domain) -> DataFrame:
    """Request limits of the sources, derived from the source ids."""
    text = F.to_json(
        F.struct(
            F.col("code").alias("source_code"),
            (F.col("id") * 10).cast("int").alias("max_per_hour"),
            F.lit(250).alias("delay_ms"),
            (F.col("id") % 3).cast("int").alias("priority"),
        )
    )
    return _config(d, text, F.col("kind") != "api")


def _config(d: Domain, data, active) -> DataFrame:
    return d.sources.select(
        "id", "code", "name", active.alias("is_active"), data.alias("data"), "created_at", "updated_at"
    )


@query(f"""{with_tables('sources')} select id, code, kind, case when kind <> 'api' then id * 10 end as max_per_hour,
  case when kind <> 'api' then 250 end as delay_ms, case when kind <> 'api' then id % 3 end as priority from sources""")
def source_settings(d: Domain) -> DataFrame:
    joined = schedule.source_settings(d.sources, settings(d))
    return joined.select("id", "code", "kind", "max_per_hour", "delay_ms", "priority")


STATE = f"""{with_tables('sources', 'jobs')}, runs as (select * from jobs where source_id is not null),
  good as (select source_id, max(struct_pack(started_at := started_at, id := id)) as g from runs
    where status <> 'failed' group by source_id),
  state as (select r.source_id, max(struct_pack(started_at := r.started_at, id := r.id, status := r.status)) as l,
    count(*) filter (r.status = 'failed' and (g.g is null or struct_pack(started_at := r.started_at, id := r.id) > g.g))
      as failures
    from runs r left join good g on g.source_id = r.source_id group by r.source_id)"""


@query(f"""{STATE} select source_id, l.id as last_job_id,
  strftime(l.started_at, '%Y-%m-%d %H:%M:%S.%f') as last_started_at, l.status as last_status, failures from state""")
def job_state(d: Domain) -> DataFrame:
    return schedule.job_state(d.jobs)


@query(f"""{STATE}, due as (select s.id as source_id, s.code, coalesce(failures, 0) as failures, l.started_at as last_started_at,
    l.started_at + to_seconds(cast(round(60 * case when coalesce(failures, 0) = 0 then s.id * 30
      else least(s.id * 30 * power(2.0, failures), greatest(720, s.id * 30)) end) as bigint)) as next_due_at
  from sources s left join state t on t.source_id = s.id where s.is_enabled and s.id % 7 <> 0)
  select source_id, code, failures, strftime(last_started_at, '%Y-%m-%d %H:%M:%S.%f') as last_started_at,
    strftime(next_due_at, '%Y-%m-%d %H:%M:%S.%f') as next_due_at from due
  where next_due_at is null or next_due_at <= (select max(started_at) from jobs)""")
def due_sources(d: Domain) -> DataFrame:
    """Sources due at the moment the last job started."""
    as_of = d.jobs.agg(F.max("started_at")).first()[0]
    return schedule.due_sources(d.sources, schedule.job_state(d.jobs), schedules(d), as_of)


@query(f"""{STATE} select s.id as source_id, s.code, failures, strftime(l.started_at, '%Y-%m-%d %H:%M:%S.%f') as last_started_at
  from sources s join state t on t.source_id = s.id where s.is_enabled and failures >= 1""")
def unreachable_sources(d: Domain) -> DataFrame:
    return schedule.unreachable_sources(d.sources, schedule.job_state(d.jobs), min_failures=1)


REPORT_DAY = date(2024, 1, 1)


@query(f"""{with_tables('sources', 'raw_items', 'bids', 'errors')},
  bids_now as (select * exclude (created_at), timestamp '2024-01-01' + to_minutes(id % 2880) as created_at from bids),
  marked as (select *, row_number() over (partition by source_id, external_id order by created_at, id) > 1 as dup from bids_now),
  r as (select source_id, count(*) as n from raw_items where created_at < timestamp '2024-01-02' group by source_id),
  b as (select source_id, count(*) as n, count(*) filter (dup) as dups from marked
    where created_at < timestamp '2024-01-02' group by source_id),
  e as (select source_id, count(*) as n from errors where occurred_at < timestamp '2024-01-02' group by source_id),
  every as (select source_id from r union select source_id from b union select source_id from e)
  select 'counts' as section, v.source_id, 'raw_items' as name, cast(coalesce(r.n, 0) as double) as value
    from every v left join r on r.source_id is not distinct from v.source_id
  union all select 'counts', v.source_id, 'bids', coalesce(b.n, 0) from every v left join b on b.source_id is not distinct from v.source_id
  union all select 'counts', v.source_id, 'errors', coalesce(e.n, 0) from every v left join e on e.source_id is not distinct from v.source_id
  union all select 'share', source_id, 'share', n / sum(n) over () from b
  union all select 'duplicates', source_id, 'duplicates', dups from b
  union all select 'errors', null, severity, count(*) from errors where occurred_at < timestamp '2024-01-02' group by severity
  union all select 'silent', s.id, s.code, 1 from sources s where is_enabled and not exists (select 1 from bids_now n
    where n.source_id = s.id and n.created_at < timestamp '2024-01-02'
      and n.created_at >= timestamp '2024-01-02' - interval 1 hour)""")
def daily_health_report(d: Domain) -> DataFrame:
    """The report of one day, over bids whose creation times are moved into that week."""
    moved = F.lit(datetime(2024, 1, 1)) + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("id") % 2880).cast("int"))
    marked = dedup.mark_duplicates(d.bids.withColumn("created_at", moved), ["source_id", "external_id"])
    return health_report(d.sources, d.raw_items, marked, d.errors, REPORT_DAY, 1)
