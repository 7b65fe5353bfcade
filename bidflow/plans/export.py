"""Export of selected bids to files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidflow.operators.lookups import require_field
from bidflow.operators.rules import active_config, rejections, source_ids_of

# The export layout used when a configuration names no columns.
DEFAULT_COLUMNS = (
    "external_id",
    "title",
    "cargo_type",
    "transport_type",
    "weight_value",
    "weight_unit",
    "price_value",
    "price_currency",
    "load_location",
    "unload_location",
    "contact_phone",
    "url",
    "published_at",
)


def export_view(
    bids: DataFrame,
    config_filter_rule: DataFrame,
    rules: Sequence[str] = (),
    columns: Sequence[str] = DEFAULT_COLUMNS,
    sources: DataFrame | None = None,
) -> DataFrame:
    """Bids that pass the named rules, in the configured columns; each name must be of an active rule."""
    active = {r["code"]: r for r in active_config(config_filter_rule)}
    unknown = sorted(set(rules) - set(active))
    if unknown:
        raise ValueError(f"no active rules {unknown}")
    chosen = [active[code] for code in sorted(set(rules))]
    ids = source_ids_of(sources, chosen) if sources is not None else {}
    passed = bids.where(F.size(rejections(bids, chosen, ids, cargo_required=False)) == 0)
    return passed.select(*[require_field(c) for c in columns])


def write_export(view: DataFrame, path: str, file_format: str = "csv") -> None:
    """Write an export, in parallel, as CSV with header or as parquet."""
    if file_format == "csv":
        # Every quote inside a text is doubled, so line breaks and quotes survive a reader.
        view.write.mode("overwrite").csv(
            path, header=True, quoteAll=True, escape='"', nullValue="", timestampFormat="yyyy-MM-dd'T'HH:mm:ss"
        )
    elif file_format == "parquet":
        view.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"export format must be csv or parquet, not {file_format!r}")


def run_exports(
    bids: DataFrame, config_export: DataFrame, config_filter_rule: DataFrame, root: str, sources: DataFrame | None = None
) -> dict[str, str]:
    """Write every active export under ``root``; returns the path of each."""
    paths = {}
    for export in active_config(config_export):
        view = export_view(
            bids, config_filter_rule, export.get("rules") or (), export.get("columns") or DEFAULT_COLUMNS, sources
        )
        path = f"{root.rstrip('/')}/{export.get('path') or export['code']}"
        write_export(view, path, export.get("format", "csv"))
        paths[export["code"]] = path
    return paths
