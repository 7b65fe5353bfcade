"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidflow.shared import staged

# A key is large when it holds HOT_ROWS rows and 1/HOT_KEYS of all rows. At most
# HOT_KEYS keys can, so their list has a bound however many rows there are.
HOT_KEYS = 100_000
HOT_ROWS = 200_000

# Rows without a key match nothing; they are spread over this many slices.
LOOSE_SLICES = 4096


def salted_join(
    rows: DataFrame,
    unique: DataFrame,
    sizes: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    spread_by: Sequence[str] = ("id",),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join to a side with one row per key, with large keys cut into slices.

    ``sizes`` has the keys and ``n_rows``, the number of ``rows`` under each. The
    rows of a large key go to slices by a hash of ``spread_by`` (columns that
    tell them apart) and its one row of ``unique`` is copied to every slice.
    Only the list of large keys is broadcast, never what hangs on them.
    """
    keys = list(keys)
    share = F.coalesce(sizes.agg(F.sum("n_rows") / F.lit(HOT_KEYS)).scalar(), F.lit(0.0))
    hot = sizes.where((F.col("n_rows") >= hot_rows) & (F.col("n_rows") >= share)).select(
        *keys, F.ceil(F.col("n_rows") / F.lit(hot_rows)).cast("int").alias("_slices")
    )
    slices = F.coalesce("_slices", F.lit(1))
    keyed = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    place = F.pmod(F.hash(*spread_by), F.when(keyed, slices).otherwise(LOOSE_SLICES))
    cut = rows.join(F.broadcast(hot), keys, "left").withColumn("_slice", place).drop("_slices")
    copies = (
        unique.join(F.broadcast(hot), keys, "left")
        .withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1)))
        .drop("_slices")
    )
    return cut.join(copies, [*keys, "_slice"], how).drop("_slice")


def attach_group(
    rows: DataFrame,
    groups: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    spread_by: Sequence[str] = ("id",),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join each row to the row of its group; ``groups`` counts its rows in ``n_rows``.

    The groups come from an aggregation that the join needs twice (for the large
    keys and for the rows), so they are written out first. ``how`` is ``left`` or
    ``inner``; a NULL key matches nothing.
    """
    groups = staged(groups, "groups")
    return salted_join(rows, groups, groups, keys, how, spread_by, hot_rows)


def left_join_optional(
    child: DataFrame, parent: DataFrame, foreign_key: str, parent_key: str
) -> DataFrame:
    """Left join on an optional reference to a unique parent key.

    Rows whose reference is NULL skip the shuffle (they would all hash to one
    partition). A frequent non-null reference is left to the adaptive skew split,
    which applies here because both sides are plain shuffles.
    """
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in parent.schema]
    linked = child.where(F.col(foreign_key).isNotNull()).join(
        parent, F.col(foreign_key) == F.col(parent_key), "left"
    )
    loose = child.where(F.col(foreign_key).isNull()).select("*", *nothing)
    return linked.unionAll(loose)
