"""Dense integer ids and row positions without a global window.

``row_number()`` over a whole table runs in one task. Here the rows are range
partitioned on the order, numbered inside their own partition, and shifted by
the sizes of the partitions before them: one shuffle of the data, and one small
row per partition for the shift.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidflow.shared import staged

_FILE, _ROW, _SLOT, _PART = "__file", "__row", "__slot", "__part"


def _order_columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def with_position(
    df: DataFrame,
    order: Sequence[str | Column],
    name: str = "position",
    on_files: bool = False,
    place: Sequence[str] = (),
) -> DataFrame:
    """Add the 0-based position of each row in the given order (nulls first).

    The physical place of a row (file, row in file) is the last sort key, so a
    large group of equal rows is still spread over range partitions and the
    numbering is replayable. ``on_files=True`` says that ``df`` is a plain file
    scan already; any other input is written out first, which also spares the
    second run of its plan that range sampling would cost. ``place`` names
    columns that tell all rows apart; then nothing is written first.
    """
    if place:
        rows, keys = df, _order_columns([*order, *place])
    else:
        rows = (df if on_files else staged(df, "unnumbered")).select(
            "*",
            F.col("_metadata.file_path").alias(_FILE),
            F.col("_metadata.row_index").alias(_ROW),
        )
        keys = [*_order_columns(order), F.col(_FILE), F.col(_ROW)]
    # The id is (partition << 33) + row in partition, taken after the sort.
    # Range bounds are sampled, so the result is written before anyone reads it.
    slotted = staged(
        rows.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .drop(_FILE, _ROW)
        .withColumn(_SLOT, F.monotonically_increasing_id()),
        "numbered",
    )
    part = F.shiftright(_SLOT, 33)
    sizes = slotted.groupBy(part.alias(_PART)).agg(F.count("*").alias("__n"))
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    # One row per range partition, so at most as many as shuffle partitions.
    shifts = sizes.select(
        _PART, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift")
    )
    in_part = F.col(_SLOT).bitwiseAND(F.lit((1 << 33) - 1))
    return (
        slotted.withColumn(_PART, part)
        .join(F.broadcast(shifts), _PART)
        .withColumn(name, (F.col("__shift") + in_part).cast("bigint"))
        .drop(_PART, _SLOT, "__shift")
    )


def with_dense_ids(
    df: DataFrame,
    order: Sequence[str | Column],
    after: int = 0,
    name: str = "id",
    on_files: bool = False,
    place: Sequence[str] = (),
) -> DataFrame:
    """Number the rows ``after + 1, after + 2, ...`` in the given order.

    One writer per table is assumed: two writers starting from the same
    ``after`` would hand out the same ids.
    """
    numbered = with_position(df.drop(name) if name in df.columns else df, order, "__pos", on_files, place)
    cols = [c for c in numbered.columns if c != "__pos"]
    return numbered.select((F.col("__pos") + F.lit(after + 1)).alias(name), *cols)
