"""Explicit schemas of the stored tables and of the rows that move between steps.

Lengths of bounded strings are kept in ``MAX_LENGTHS`` because file tables do
not enforce them; ``operators.integrity.constraint_audit`` checks them.
"""

from __future__ import annotations

from pyspark.sql import types as T

_LONG, _INT, _STR = T.LongType(), T.IntegerType(), T.StringType()
_BOOL, _TS, _DOUBLE = T.BooleanType(), T.TimestampType(), T.DoubleType()
WEIGHT, PRICE = T.DecimalType(14, 3), T.DecimalType(14, 2)


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


SOURCES = _struct(
    ("id", _LONG, False),
    ("code", _STR, False),
    ("name", _STR, False),
    ("kind", _STR, False),
    ("is_enabled", _BOOL, False),
    ("description", _STR, True),
    ("created_at", _TS, False),
    ("updated_at", _TS, False),
)

RAW_ITEMS = _struct(
    ("id", _LONG, False),
    ("source_id", _LONG, False),
    ("external_id", _STR, True),
    ("url", _STR, True),
    ("fetched_at", _TS, False),
    ("payload", _STR, False),
    ("status", _STR, False),
    ("error_message", _STR, True),
    ("hash", _STR, True),
    ("created_at", _TS, False),
)

BIDS = _struct(
    ("id", _LONG, False),
    ("source_id", _LONG, False),
    ("raw_item_id", _LONG, True),
    ("external_id", _STR, True),
    ("title", _STR, False),
    ("description", _STR, True),
    ("cargo_type", _STR, True),
    ("transport_type", _STR, True),
    ("weight_value", WEIGHT, True),
    ("weight_unit", _STR, True),
    ("price_value", PRICE, True),
    ("price_currency", _STR, True),
    ("load_location", _STR, True),
    ("unload_location", _STR, True),
    ("load_region", _STR, True),
    ("unload_region", _STR, True),
    ("published_at", _TS, True),
    ("received_at", _TS, True),
    ("contact_name", _STR, True),
    ("contact_phone", _STR, True),
    ("contact_email", _STR, True),
    ("url", _STR, True),
    ("dedup_key", _STR, True),
    ("is_duplicate", _BOOL, False),
    ("created_at", _TS, False),
    ("updated_at", _TS, False),
)

JOBS = _struct(
    ("id", _LONG, False),
    ("source_id", _LONG, True),
    ("job_type", _STR, False),
    ("status", _STR, False),
    ("started_at", _TS, True),
    ("finished_at", _TS, True),
    ("items_total", _INT, True),
    ("items_created", _INT, True),
    ("items_updated", _INT, True),
    ("error_message", _STR, True),
    ("created_at", _TS, False),
)

ERRORS = _struct(
    ("id", _LONG, False),
    ("source_id", _LONG, True),
    ("job_id", _LONG, True),
    ("occurred_at", _TS, False),
    ("severity", _STR, False),
    ("message", _STR, False),
    ("details", _STR, True),
    ("created_at", _TS, False),
)

# ``data`` stays the JSON text of the row; rule readers parse it with from_json.
CONFIG = _struct(
    ("id", _LONG, False),
    ("code", _STR, False),
    ("name", _STR, False),
    ("is_active", _BOOL, False),
    ("data", _STR, False),
    ("created_at", _TS, False),
    ("updated_at", _TS, False),
)

CONFIG_TABLES = (
    "config_source",
    "config_filter_rule",
    "config_classifier",
    "config_dedup",
    "config_schedule",
    "config_antibot",
    "config_export",
)

TABLES = {
    "sources": SOURCES,
    "raw_items": RAW_ITEMS,
    "bids": BIDS,
    "jobs": JOBS,
    "errors": ERRORS,
    **{name: CONFIG for name in CONFIG_TABLES},
}

# Rows a reader hands to the harvest, before ids exist. source_id 0 means unset.
PROVIDED = _struct(
    ("source_code", _STR, False),
    ("source_id", _LONG, False),
    ("external_id", _STR, True),
    ("payload", _STR, False),
    ("url", _STR, True),
    ("created_at", _TS, False),
    ("received_at", _TS, False),
)

# Domain view of a bid (what callers see; storage names differ).
BID_ENTITY = _struct(
    ("id", _LONG, True),
    ("source_id", _LONG, False),
    ("raw_item_id", _LONG, True),
    ("external_id", _STR, True),
    ("title", _STR, False),
    ("description", _STR, False),
    ("cargo_type", _STR, True),
    ("transport_type", _STR, True),
    ("load_point", _STR, True),
    ("unload_point", _STR, True),
    ("weight_tons", _DOUBLE, True),
    ("price", _DOUBLE, True),
    ("currency", _STR, True),
    ("contact", _STR, True),
    ("url", _STR, True),
    ("published_at", _TS, True),
    ("created_at", _TS, False),
)

# Longest text each bounded column may hold.
MAX_LENGTHS = {
    "sources": {"code": 50, "name": 255, "kind": 50},
    "raw_items": {"external_id": 128, "url": 1024, "status": 32, "hash": 64},
    "bids": {
        "external_id": 128,
        "title": 512,
        "cargo_type": 128,
        "transport_type": 128,
        "weight_unit": 16,
        "price_currency": 8,
        "load_location": 255,
        "unload_location": 255,
        "load_region": 255,
        "unload_region": 255,
        "contact_name": 255,
        "contact_phone": 64,
        "contact_email": 255,
        "url": 1024,
        "dedup_key": 512,
    },
    "jobs": {"job_type": 64, "status": 32},
    "errors": {"severity": 32, "message": 512},
    **{name: {"code": 128, "name": 255} for name in CONFIG_TABLES},
}

# What a column with a default may hold, the default first.
DOMAINS = {
    "raw_items": {"status": ("new", "processed", "error")},
    "jobs": {"status": ("pending", "running", "done", "failed")},
    "errors": {"severity": ("error", "warning", "critical")},
}

# Child table, child column, parent table, rule on parent delete.
FOREIGN_KEYS = (
    ("raw_items", "source_id", "sources", "cascade"),
    ("bids", "source_id", "sources", "restrict"),
    ("bids", "raw_item_id", "raw_items", "set_null"),
    ("jobs", "source_id", "sources", "set_null"),
    ("errors", "source_id", "sources", "set_null"),
    ("errors", "job_id", "jobs", "set_null"),
)

# Columns a caller may name in rules, dedup keys, searches and exports.
BID_FIELDS = frozenset(f.name for f in BIDS)
