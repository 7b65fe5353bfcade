"""Configuration rows used by the queries; the operators read them as any other table."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from bidflow.shared import new_path
from bidflow.sources.tables import read_config

NOW = datetime(2025, 12, 3, 10, 15, 0)

FILTER_RULES = {
    "price_floor": {"mode": "include", "field": "price_value", "op": "ge", "values": ["20000"], "sources": []},
    "no_africa": {"mode": "exclude", "field": "load_region", "op": "in", "values": ["AFRICA"], "sources": []},
    "heavy_only": {"mode": "include", "field": "weight_value", "op": "between", "values": ["10", "50"], "sources": ["src1", "src12"]},
    "no_blue_bolt": {"mode": "exclude", "field": "title", "op": "keywords", "values": ["blue bolt", "anvil"], "sources": []},
    "no_widget_end": {"mode": "exclude", "field": "title", "op": "rlike", "values": ["^hot .*gear$"], "sources": []},
}
INACTIVE_RULE = {"mode": "exclude", "field": "title", "op": "rlike", "values": ["."], "sources": []}

CLASSIFIERS = {
    "c1": {"target": "cargo_type", "value": "fasteners", "priority": 2, "keywords": ["bolt", "rod"], "regex": ""},
    "c2": {"target": "cargo_type", "value": "machines", "priority": 2, "keywords": ["gear", "anvil"], "regex": ""},
    "c3": {"target": "cargo_type", "value": "goods", "priority": 3, "keywords": [], "regex": "widget|gizmo"},
    "c4": {"target": "cargo_type", "value": "special", "priority": 1, "keywords": ["hot bolt", "plate"], "regex": ""},
    "t1": {"target": "transport_type", "value": "tipper", "priority": 1, "keywords": ["red", "hot"], "regex": ""},
    "t2": {"target": "transport_type", "value": "flatbed", "priority": 5, "keywords": [], "regex": r"(?i)\bsmall\b"},
}

DEDUP = {"d1": {"keys": ["source_id", "external_id"], "null_policy": "skip", "window_days": 0, "keep": "first"}}
DEDUP_TWICE = {
    "by_place": {"keys": ["title", "contact_phone", "load_location"], "null_policy": "equal", "window_days": 30, "keep": "last"},
    "by_sender": {"keys": ["source_id", "contact_phone", "title"], "null_policy": "skip", "window_days": 0, "keep": "first"},
}
ANTIBOT = {"delays": {"delay_ms": 250}, "agents": {"rotate": True}}

EXPORTS = {
    "daily": {"columns": [], "rules": ["price_floor", "no_africa"], "format": "csv", "path": "daily"},
    "short": {"columns": ["external_id", "title", "price_value"], "rules": ["no_blue_bolt"], "format": "parquet", "path": "short"},
}


def config(spark: SparkSession, rows: dict[str, dict], inactive: dict[str, dict] | None = None) -> DataFrame:
    """A configuration table of active rows, plus rows that are switched off, by way of a JSON seed file."""
    active = [(code, True, data) for code, data in rows.items()]
    off = [(code, False, data) for code, data in (inactive or {}).items()]
    at = NOW.isoformat()
    seed = [
        (json.dumps({"id": i, "code": code, "name": code, "is_active": flag, "data": data, "created_at": at, "updated_at": at}),)
        for i, (code, flag, data) in enumerate(active + off, start=1)
    ]
    path = new_path(spark, "seed")
    spark.createDataFrame(seed, "value string").coalesce(1).write.text(path)
    return read_config(spark, path)


def filter_rules(spark: SparkSession) -> DataFrame:
    return config(spark, FILTER_RULES, {"everything": INACTIVE_RULE})


def classifiers(spark: SparkSession) -> DataFrame:
    return config(spark, CLASSIFIERS)


def dedup_rules(spark: SparkSession) -> DataFrame:
    return config(spark, DEDUP)


def exports(spark: SparkSession) -> DataFrame:
    return config(spark, EXPORTS)


def antibot(spark: SparkSession) -> DataFrame:
    return config(spark, ANTIBOT)


# Rows of the tables above, switched-off ones last, as the SQL twins see them.
CODES = {
    "config_filter_rule": [*FILTER_RULES, "everything"],
    "config_classifier": list(CLASSIFIERS),
    "config_dedup": list(DEDUP),
    "config_antibot": list(ANTIBOT),
    "config_export": list(EXPORTS),
}
