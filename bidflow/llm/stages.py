"""Stages of the corpus pipeline: (spark, docs, sf_dir) to a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidflow.llm import decontamination, line_dedup, mixing, near_dedup, toxicity
from bidflow.llm.common import table
from bidflow.operators.ids import with_position
from bidflow.shared import cleared, staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain of classifiers calls toxic go."""
    docs = docs.select(*COLUMNS)
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.scored(docs, chain).where(~F.col("toxic")).select(*COLUMNS)


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents go from all of them; every document stays with what is left."""
    return line_dedup.deduplicated(docs.select(*COLUMNS)).select(
        "doc_id",
        F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text")).alias("text"),
        "lang",
        "source",
        F.when(F.col("n_dropped") > 0, F.length("kept_text").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one with the smallest id."""
    docs = docs.select(*COLUMNS)
    with cleared(spark) as scope:
        rows = near_dedup.near_duplicates(docs.select("doc_id", "text"))
        same_rows = rows.groupBy("class", "id", "doc_id").agg(F.count("*").alias("n"))
        best = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "id", "n")).alias("best")
        kept = same_rows.groupBy("class").agg(best)
        kept = kept.select(F.col("best.doc_id").alias("_id"), F.col("best.id").alias("_text"), F.col("best.n").alias("_n"))
        kept = scope.keep(staged(kept, "near-kept"))
    keyed = docs.withColumn("_hash", near_dedup.text_id(F.col("text")))

    def rows_of(some: DataFrame) -> DataFrame:
        same = (keyed["_hash"] == some["_text"]) & keyed["doc_id"].eqNullSafe(some["_id"])
        return keyed.join(some, same, "left_semi")

    single = rows_of(kept.where("_n = 1")).select(*COLUMNS)
    repeated = kept.where("_n > 1")
    if repeated.isEmpty():
        return single
    # Rows equal in id and text: one of them.
    return single.unionAll(rows_of(repeated).dropDuplicates(["doc_id", "_hash"]).select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    benchmark = table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = decontamination.with_leaks(docs.select(*COLUMNS), benchmark)
    return found.where(F.size("leaks") == 0).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with how many it takes, repeats counted. Equal rows stay rows of their own."""
    taken = staged(mixing.mixed(docs), "mix-taken")
    key = F.xxhash64("doc_id", "source", "text_hash").alias("_key")
    taken = taken.select(key, "size", "source_size", "target", "taken")
    hashed = docs.select(*COLUMNS).withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    keyed = hashed.select(*COLUMNS, key)
    repeated = staged(taken.groupBy("_key").agg(F.count("*").alias("n")).where("n > 1").select("_key"), "mix-repeated")
    if repeated.isEmpty():
        return keyed.join(taken.where("taken > 0"), "_key").drop("_key")
    single = keyed.join(taken.join(repeated, "_key", "left_anti").where("taken > 0"), "_key").drop("_key")
    # Both sides have the same keys as often, so the places of equal rows match.
    rows = with_position(keyed.join(repeated, "_key", "left_semi"), ["_key"], "_place")
    theirs = with_position(taken.join(repeated, "_key", "left_semi"), ["_key"], "_place")
    both = rows.drop("_key").join(theirs.where("taken > 0").drop("_key"), "_place").drop("_place")
    return single.unionByName(both.select(*single.columns))
