"""Mixing sources to target weights by Sainte-Laguë apportionment.

The words of a source, documents in seeded order, are cut into blocks of equal
length: 64 words, and a power of two of at most a 64th of the source where that is
less, so that a block is never a large part of a target. Blocks go to the sources
of their length by highest quotients weight / 1, / 3, / 5 ..., then the same way
to the shards of a source. A shard takes all its blocks as often as its quota
holds them, and the rest by a seeded order of blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidflow.shared import staged

BLOCK_WORDS = 64
# A source has so many blocks at least, if it has as many words.
MIN_BLOCKS = 64
SHARD_WORDS = 1_000_000
MAX_SOURCES = 100_000
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
REPEATS = 2
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = SHARE, most: float = REPEATS) -> list[float]:
    """Shares of ``share`` times all sizes by weight; what is above ``most`` times a size goes to the others by weight."""
    left = share * sum(sizes)
    out, open_ = [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n > 0 and weights[i] > 0]
    while open_:
        level = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if level * weights[i] > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = level * weights[i]
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def apportion(weights: Sequence[float], seats: int, caps: Sequence[int]) -> list[int]:
    """Seats by highest quotients w / (2 a + 1), never more than a cap; the earlier one wins a tie."""
    w, most = np.asarray(weights, dtype=float), np.asarray(caps, dtype=np.int64)
    most = np.where(w > 0, most, 0)
    if most.sum() <= seats:
        return most.tolist()

    def above(bar: float) -> np.ndarray:
        """How many quotients of each are at least ``bar``."""
        return np.minimum(np.floor(w / (2 * bar) + 0.5), most).astype(np.int64)

    low, high = 0.0, float(w.max()) * 1.01
    for _ in range(100):
        bar = (low + high) / 2
        if bar > 0 and above(bar).sum() <= seats:
            high = bar
        else:
            low = bar
    out = above(high)
    queue = [(-w[i] / (2 * out[i] + 1), i) for i in range(len(w)) if out[i] < most[i]]
    heapq.heapify(queue)
    for _ in range(seats - int(out.sum())):
        _, i = heapq.heappop(queue)
        out[i] += 1
        if out[i] < most[i]:
            heapq.heappush(queue, (-w[i] / (2 * out[i] + 1), i))
    return out.tolist()


def block_length(size: int, most: int = BLOCK_WORDS) -> int:
    """Words of a block of a source: the largest power of two that gives ``MIN_BLOCKS`` blocks, ``most`` at most."""
    return min(most, 1 << (max(1, size // MIN_BLOCKS).bit_length() - 1))


def drawn(*parts) -> Column:
    """A seeded hash as 32 hex digits, the same in any SQL engine."""
    return F.md5(F.concat_ws("|", F.lit(str(SEED)), *[p.cast("string") for p in parts]).cast("binary"))


def digits(h: Column) -> Column:
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")


def mixed(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = REPEATS,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """(doc_id, text_hash, source, size, source_size, target, taken) for every row.

    ``size`` is the number of words, ``taken`` how many of them the mix holds,
    repeats counted. Sources take ``weights`` in the order of their code points,
    null last. A null or empty text has no words and gives none; null ids (drawn
    by their text) and repeated rows are rows like any other (between equal rows
    it is left open which one gives the larger part). An empty table gives an empty one. At most
    MAX_SOURCES sources are accepted, since their totals are held by the driver;
    documents and blocks never are.
    """
    spark = docs.sparkSession
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint")
    rows = staged(
        docs.select(
            "doc_id",
            F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
            "source",
            words.alias("size"),
            drawn(F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))).alias("draw"),
        ),
        "sizes",
    )
    # n: null last, so that sources need no null handling in joins.
    per_source = rows.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(per_source) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    per_source.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in per_source]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, most)
    lengths = [block_length(n, block_words) for n in sizes]
    # A source has a shard for each shard_words words.
    known = spark.createDataFrame(
        [
            (r["source"], i, size, goal[i], max(1, -(-size // shard_words)), lengths[i])
            for i, (r, size) in enumerate(zip(per_source, sizes, strict=True))
        ],
        "known string, n int, source_size bigint, target double, n_shards bigint, length bigint",
    )
    placed = (
        rows.join(F.broadcast(known), rows["source"].eqNullSafe(known["known"]))
        .drop("known")
        .withColumn("shard", F.pmod(digits(F.col("draw")), F.col("n_shards")))
    )
    worded = placed.where("size > 0")
    shards = staged(
        worded.groupBy("n", "shard", "length")
        .agg(F.sum("size").alias("words"))
        .withColumn("blocks", F.ceil(F.col("words") / F.col("length")).cast("bigint")),
        "shards",
    )
    blocks = {r["n"]: r["blocks"] for r in shards.groupBy("n").agg(F.sum("blocks").alias("blocks")).collect()}
    seats_of = {}
    for length in set(lengths):
        order = [i for i in sorted(blocks) if lengths[i] == length]
        goals = [goal[i] for i in order]
        seats = apportion(goals, round(sum(goals) / length), [int(most * blocks[i]) for i in order])
        seats_of.update(zip(order, seats, strict=True))

    def quotas(of: pd.DataFrame) -> pd.DataFrame:
        of = of.sort_values("shard")
        mine = apportion(of["words"].tolist(), seats_of[int(of["n"].iloc[0])], (most * of["blocks"]).astype("int64").tolist())
        return of.assign(quota=mine)

    quota = shards.groupBy("n").applyInPandas(quotas, "n int, shard bigint, length bigint, words bigint, blocks bigint, quota bigint")
    quota = staged(quota, "quotas")
    extra = (
        quota.where("quota % blocks > 0")
        .select("n", "shard", (F.col("quota") % F.col("blocks")).alias("rest"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
        .withColumn("rank", F.row_number().over(Window.partitionBy("n", "shard").orderBy(drawn(F.col("n"), F.col("shard"), F.col("block")), "block")))
        .where("rank <= rest")
        .select("n", "shard", "block", F.lit(True).alias("taken_once_more"))
    )
    line = Window.partitionBy("n", "shard").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    spread = worded.withColumn("end", F.sum("size").over(line)).withColumn("start", F.col("end") - F.col("size"))
    low, high = F.col("block") * F.col("length"), (F.col("block") + 1) * F.col("length")
    cut = spread.withColumn(
        "block",
        F.explode(
            F.sequence(F.floor(F.col("start") / F.col("length")), F.floor((F.col("end") - 1) / F.col("length")))
        ),
    ).withColumn("overlap", F.least("end", high) - F.greatest("start", low))
    out = ["doc_id", "text_hash", "source", "size", "source_size", "target"]
    more = (
        # The planner takes the exploded blocks for as small as their shards and would broadcast them.
        cut.join(extra.hint("merge"), ["n", "shard", "block"], "left")
        .groupBy(*out, "n", "shard", "start")
        .agg(F.sum(F.when(F.col("taken_once_more"), F.col("overlap")).otherwise(0)).alias("more"))
    )
    base = quota.select("n", "shard", F.floor(F.col("quota") / F.col("blocks")).alias("times"))
    taken = more.join(base, ["n", "shard"]).select(
        *out, (F.col("size") * F.col("times") + F.col("more")).cast("bigint").alias("taken")
    )
    empty = placed.where("size = 0").select(*out, F.lit(0).cast("bigint").alias("taken"))
    return taken.unionAll(empty)
