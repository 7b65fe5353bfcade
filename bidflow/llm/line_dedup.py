"""Lines that many documents share, and which lines each document keeps.

The hashes of all lines are pre-aggregated in slices of documents, partitioned
by range, sorted by document and position inside a range and streamed once, so
that each hash meets its total and its first occurrence. Decisions go back to
the documents as run-length bitmaps; texts are only read to split and to apply
them. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# A hash that is in very many documents is counted and joined in so many slices.
SLICES = 256
ROW = ["doc_id", "text_hash"]


def lines_of(text: Column) -> Column:
    """The lines of a text; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """What makes two lines equal: white space stripped at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def with_row_key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))


def occurrences(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(doc_id, text_hash, position, h1, h2, slice) of every line whose key has ``min_chars`` code points."""
    rows = with_row_key(docs).select(*ROW, F.posexplode(lines_of(F.col("text"))).alias("position", "line"))
    key = line_key(F.col("line"))
    return (
        rows.select(*ROW, "position", key.alias("key"))
        .where(F.length("key") >= min_chars)
        .select(
            *ROW,
            "position",
            F.xxhash64("key").alias("h1"),
            F.xxhash64(F.lit(1), F.col("key")).alias("h2"),
            F.pmod(F.xxhash64(F.lit(2), *ROW), F.lit(SLICES)).cast("smallint").alias("slice"),
        )
    )


def repeated_keys(docs: DataFrame, min_docs: int, min_chars: int = 1) -> DataFrame:
    """(h1, h2, slice, n_docs, first) of the keys in ``min_docs`` documents; first: (doc_id, text_hash, position)."""
    # A document counts once for a key, each of several equal rows counts.
    keys = F.array_distinct(
        F.transform(
            F.filter(F.transform(lines_of(F.col("text")), line_key), lambda k: F.length(k) >= min_chars),
            lambda k: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2")),
        )
    )
    entries = with_row_key(docs).select(*ROW, F.explode(keys).alias("key")).select(*ROW, "key.h1", "key.h2")
    sliced = (
        entries.withColumn("slice", F.pmod(F.xxhash64(F.lit(2), *ROW), F.lit(SLICES)).cast("smallint"))
        .groupBy("h1", "h2", "slice")
        .agg(F.count("*").alias("n"), F.min(F.struct(*ROW)).alias("first"))
    )
    ordered = sliced.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", "slice")
    whole = Window.partitionBy("h1", "h2")
    return (
        ordered.withColumns({"n_docs": F.sum("n").over(whole), "first": F.min("first").over(whole)})
        .where(F.col("n_docs") >= min_docs)
        .select("h1", "h2", "slice", "n_docs", "first")
    )


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once; repeated in a lambda it would run for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def kept_runs(dropped: Column, n_lines: Column) -> Column:
    """A bitmap of kept lines as runs (first, last), from the sorted dropped positions."""

    def runs(ends: Column) -> Column:
        gaps = F.transform(
            F.sequence(F.lit(1), F.size(ends) - 1),
            lambda i: F.struct((F.get(ends, i - 1) + 1).alias("first"), (F.get(ends, i) - 1).alias("last")),
        )
        return F.filter(gaps, lambda r: r["first"] <= r["last"])

    return let(F.concat(F.array(F.lit(-1)), dropped, F.array(n_lines)), runs)


def line_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none") -> DataFrame:
    """(doc_id, text_hash, dropped) for documents that lose lines; dropped: sorted positions.

    Keys found in at least ``min_docs`` documents lose all their lines
    (``keep="none"``) or all but the very first, by doc_id, text and position
    (``keep="first"``). Equal rows share one decision.
    """
    if keep not in ("none", "first"):
        raise ValueError(f"keep is {keep!r}, not 'none' or 'first'")
    found = occurrences(docs, min_chars).join(repeated_keys(docs, min_docs, min_chars), ["h1", "h2", "slice"])
    if keep == "first":
        here = F.struct(*ROW).eqNullSafe(F.col("first"))
        first_line = F.min(F.when(here, F.col("position"))).over(Window.partitionBy(*ROW, "h1", "h2"))
        found = found.withColumn("_first", first_line).where(~here | (F.col("position") != F.col("_first")))
    return found.groupBy(*ROW).agg(F.array_sort(F.collect_set("position")).alias("dropped"))


def deduplicated(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none") -> DataFrame:
    """All documents with n_lines, n_dropped, kept (bitmap as runs) and kept_text.

    Null text counts as empty: one empty line, never dropped, since its key is
    shorter than ``min_chars``. Null ids, equal ids and equal rows are documents
    like any other; extra columns pass through, whatever their names, but those
    named like the four new ones are replaced. An empty table gives an empty one.
    """
    own = ("n_lines", "n_dropped", "kept", "kept_text")
    # The row as one value: no name of its columns can clash with one used here.
    packed = docs.drop(*own).select(F.struct(*docs.drop(*own).columns).alias("row"))
    rows = packed.withColumn("text_hash", F.xxhash64(F.coalesce("row.text", F.lit(""))))
    drops = line_bitmaps(docs.select("doc_id", "text"), min_docs, min_chars, keep)
    drops = drops.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "dropped")
    same = F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
    lines = lines_of(F.col("row.text"))
    none = F.array().cast("array<int>")
    joined = rows.join(drops, same, "left").select("row", F.coalesce("dropped", none).alias("dropped"), F.size(lines).alias("n_lines"))
    kept_lines = let(
        lines,
        lambda all_: F.flatten(
            F.transform(F.col("kept"), lambda r: F.slice(all_, r["first"] + 1, r["last"] - r["first"] + 1))
        ),
    )
    whole = F.size("dropped") == 0
    text = F.when(whole, F.coalesce("row.text", F.lit(""))).otherwise(F.array_join(kept_lines, "\n"))
    return joined.withColumn("kept", kept_runs(F.col("dropped"), F.col("n_lines"))).select(
        "row.*", "n_lines", F.size("dropped").alias("n_dropped"), "kept", text.alias("kept_text")
    )
