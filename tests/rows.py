"""Small tables for tests."""

from __future__ import annotations

from datetime import datetime, timedelta

from bidflow import schemas

T0 = datetime(2025, 1, 1)


def sources(spark, rows):
    """(id, code, name, is_enabled) tuples."""
    full = [(i, code, name, "html", on, None, T0, T0) for i, code, name, on in rows]
    return spark.createDataFrame(full, schemas.SOURCES)


def provided(spark, rows):
    """(source_code, source_id, external_id, payload) tuples, one second apart."""
    full = [
        (code, sid, ext, payload, None, T0 + timedelta(seconds=i), T0 + timedelta(seconds=i))
        for i, (code, sid, ext, payload) in enumerate(rows)
    ]
    return spark.createDataFrame(full, schemas.PROVIDED)


def bids(spark, rows):
    """Dicts of the columns that matter; the others get a default."""
    base = {f.name: None for f in schemas.BIDS}
    base.update(source_id=1, title="t", is_duplicate=False, created_at=T0, updated_at=T0)
    full = [tuple({**base, "id": i + 1, **row}[f.name] for f in schemas.BIDS) for i, row in enumerate(rows)]
    return spark.createDataFrame(full, schemas.BIDS)


def raw_items(spark, rows):
    """(id, source_id, external_id, payload) tuples."""
    full = [(i, sid, ext, None, T0, payload, "new", None, None, T0) for i, sid, ext, payload in rows]
    return spark.createDataFrame(full, schemas.RAW_ITEMS)


def codes(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "code string")
