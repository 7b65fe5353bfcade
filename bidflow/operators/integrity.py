"""Lineage joins, reference and constraint audits, effects of deletes, retention."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidflow.operators.skew import left_join_optional
from bidflow.schemas import DOMAINS, FOREIGN_KEYS, MAX_LENGTHS, TABLES


def _renamed(df: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in columns])


def bid_lineage(bids: DataFrame, raw_items: DataFrame, sources: DataFrame) -> DataFrame:
    """Each bid with its source and, if it has one, its raw item."""
    raw = _renamed(raw_items, "raw", ["id", "external_id", "fetched_at", "status"])
    src = _renamed(sources, "source", ["id", "code", "kind"]).withColumnRenamed("source_id", "_sid")
    rows = bids.select("id", "source_id", "raw_item_id", "external_id")
    linked = left_join_optional(rows, raw, "raw_item_id", "raw_id")
    return linked.join(src, linked["source_id"] == src["_sid"], "inner").drop("_sid")


def error_lineage(errors: DataFrame, jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """Each error with its job and its source, where it has them."""
    job = _renamed(jobs, "job", ["id", "job_type", "status"]).withColumnRenamed("job_id", "_jid")
    src = _renamed(sources, "source", ["id", "code"]).withColumnRenamed("source_id", "_sid")
    rows = errors.select("id", "source_id", "job_id", "severity", "message")
    with_job = left_join_optional(rows, job, "job_id", "_jid").drop("_jid")
    # Sources are few: their file size lets Catalyst broadcast them, so NULLs do not pile up.
    return with_job.join(src, F.col("source_id") == F.col("_sid"), "left").drop("_sid")


def foreign_key_orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """Child rows whose parent is missing, with the name of the broken reference."""
    found = []
    for child, column, parent, _ in FOREIGN_KEYS:
        orphans = (
            tables[child]
            .where(F.col(column).isNotNull())
            .select(F.col("id").alias("child_id"), F.col(column).alias("parent_id"))
            .join(tables[parent].select(F.col("id").alias("parent_id")), "parent_id", "left_anti")
        )
        found.append(
            orphans.select(F.lit(f"{child}.{column}").alias("reference"), "child_id", "parent_id")
        )
    return reduce(DataFrame.unionAll, found)


def delete_effects(tables: dict[str, DataFrame], parent: str, ids: DataFrame) -> DataFrame:
    """What deleting ``ids`` from ``parent`` does to its children, one row per hit.

    Effects: ``deleted`` (cascade), ``blocked`` (restrict), ``set_null``. Deleted
    raw items in turn release the bids that point to them.
    """
    gone = ids.select(F.col("id").alias("parent_id"))
    effect = {"cascade": "deleted", "restrict": "blocked", "set_null": "set_null"}
    hits = []
    for child, column, owner, rule in FOREIGN_KEYS:
        if owner != parent:
            continue
        rows = tables[child].select(F.col("id").alias("child_id"), F.col(column).alias("parent_id"))
        hit = rows.join(gone, "parent_id", "left_semi")
        hits.append(
            hit.select(F.lit(f"{child}.{column}").alias("reference"), F.lit(effect[rule]).alias("effect"), "child_id")
        )
        if rule == "cascade":
            dropped = hit.select(F.col("child_id").alias("id"))
            below = [fk for fk in FOREIGN_KEYS if fk[2] == child]
            if below:
                hits.append(delete_effects(tables, child, dropped))
    return reduce(DataFrame.unionAll, hits)


def delete_sources(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """All tables after deleting sources; an error when bids still refer to them."""
    gone = ids.select("id")
    by_source = gone.select(F.col("id").alias("source_id"))
    blocking = tables["bids"].join(by_source, "source_id", "left_semi")
    if not blocking.isEmpty():
        raise ValueError("sources still have bids")
    raw_left = tables["raw_items"].join(by_source, "source_id", "left_anti").select(*tables["raw_items"].columns)
    raw_gone = tables["raw_items"].join(by_source, "source_id", "left_semi").select("id")
    return {
        **tables,
        "sources": tables["sources"].join(gone, "id", "left_anti"),
        "raw_items": raw_left,
        "bids": release(tables["bids"], "raw_item_id", raw_gone),
        "jobs": release(tables["jobs"], "source_id", gone),
        "errors": release(tables["errors"], "source_id", gone),
    }


def release(child: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """Set a reference to NULL where its parent is in ``gone`` (unique ids)."""
    mark = gone.select(F.col("id").alias("_gone"))
    joined = left_join_optional(child, mark, column, "_gone")
    kept = F.when(F.col("_gone").isNull(), F.col(column))
    return joined.withColumn(column, kept).select(*child.columns)


def retention(raw_items: DataFrame, bids: DataFrame, cutoff: datetime) -> tuple[DataFrame, DataFrame]:
    """Drop raw items created before ``cutoff``; bids that pointed to them lose the link."""
    if "created_part" in raw_items.columns:
        # Whole day folders go without being read; only the boundary day is filtered.
        kept = raw_items.where(F.col("created_part") >= F.lit(cutoff.date()))
    else:
        kept = raw_items
    kept = kept.where(F.col("created_at") >= F.lit(cutoff))
    old = raw_items.where(F.col("created_at") < F.lit(cutoff)).select("id")
    return kept, release(bids, "raw_item_id", old)


def constraint_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """Violations per table, column and rule, zero counts included.

    Rules: required columns, longest text, allowed values of columns with a
    default, unique codes of sources and configurations. One scan per
    table; the counts are turned into rows after the aggregation.
    """
    reports = []
    for name, df in tables.items():
        checks: dict[tuple[str, str], object] = {}
        for field in TABLES[name]:
            if not field.nullable:
                checks[(field.name, "not_null")] = F.count_if(F.col(field.name).isNull())
        for column, limit in MAX_LENGTHS.get(name, {}).items():
            checks[(column, "max_length")] = F.count_if(F.length(column) > limit)
        for column, allowed in DOMAINS.get(name, {}).items():
            checks[(column, "domain")] = F.count_if(~F.col(column).isin(*allowed))
        counts = df.agg(*[c.alias(f"c{i}") for i, c in enumerate(checks.values())])
        rows = [
            F.struct(F.lit(column).alias("column_name"), F.lit(rule).alias("rule"), F.col(f"c{i}").alias("violations"))
            for i, (column, rule) in enumerate(checks)
        ]
        reports.append(
            counts.select(F.explode(F.array(*rows)).alias("r")).select(F.lit(name).alias("table_name"), "r.*")
        )
        if name == "sources" or name.startswith("config_"):
            repeated = df.groupBy("code").count().where("count > 1")
            reports.append(
                repeated.agg(F.count("*").alias("violations")).select(
                    F.lit(name).alias("table_name"),
                    F.lit("code").alias("column_name"),
                    F.lit("unique").alias("rule"),
                    "violations",
                )
            )
    return reduce(DataFrame.unionAll, reports)
