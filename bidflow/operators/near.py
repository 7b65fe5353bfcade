"""Near duplicates: texts that share most of their word triples.

An exact set-similarity join. A text of which more triples are its own than two
similar texts may differ in has no partner; such triples are counted first, in
blocks of their hashes, and most texts go no further. Triples that a single text has are left out, the
others are ordered from rare to frequent, and two similar texts share one among
the first few of each: fewer of the shorter text than of the longer one, and only
at places from which enough triples are left for both. So length and place are
part of the key two texts meet under, and a frequent passage is no meeting point
unless it makes up nearly all of a text. Meeting points with many texts on both
sides are crowds of alike texts as a rule: they are compared with one of them
first, and then only across the classes that this gives. Every link is confirmed
by the exact Jaccard similarity of the whole texts; groups are the connected
parts of the links, as if all pairs had been compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidflow.functions.text import tokens
from bidflow.operators.skew import HOT_ROWS, attach_group, salted_join
from bidflow.shared import cleared, staged

# A meeting point with at most so many texts on one side gives its pairs at once.
FEW = 32
# Lengths are told apart by this ratio where texts meet.
RATIO = 1.05
# Bytes of text whose triples are sorted at a time, and whose triples make a part of all hashes.
BLOCK_BYTES = 4 << 20
PART_BYTES = 4 << 20

_RNG = np.random.default_rng(20251205)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LETTERS = _RNG.integers(1, 1 << 63, size=256, dtype=np.uint64)


def shingles(words: Column, size: int = 3) -> Column:
    """Distinct 64-bit hashes of all runs of ``size`` words (of the whole text if shorter).

    ``words`` must be a stored column: an expression would be run once per word.
    """
    last = F.greatest(F.size(words) - size, F.lit(0))
    runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(words, i + 1, size)))
    return F.array_distinct(runs)


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def triples_of(texts: list[bytes], size: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, number of the text) of all runs of ``size`` words that single spaces part, of whole texts if shorter."""
    data = np.frombuffer(b" ".join(texts), np.uint8)
    lengths = np.array([len(text) for text in texts], dtype=np.int64)
    heads = np.append(0, np.cumsum(lengths + 1)[:-1])
    spaces = np.flatnonzero(data == 32)
    starts, ends = np.append(0, spaces + 1), np.append(spaces, len(data))
    first = np.searchsorted(starts, heads)
    # Of each word: its text, and the last word of its run.
    owner = np.repeat(np.arange(len(texts)), np.diff(np.append(first, len(starts))))
    final = np.append(first[1:], len(starts)) - 1
    word = np.arange(len(starts))
    runs = (word + size - 1 <= final[owner]) | (word == first[owner])
    last = np.minimum(word + size - 1, final[owner])[runs]
    low, high, owner = starts[runs], ends[last], owner[runs]
    with np.errstate(over="ignore"):
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        up, down = np.full(len(data) + 1, _BASE), np.full(len(data) + 1, inverse)
        up[0] = down[0] = 1
        np.cumprod(up, out=up)
        np.cumprod(down, out=down)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_LETTERS[data] * up[:-1], out=sums[1:])
        return _mixed((sums[high] - sums[low]) * down[low]), owner


def _by_hash(tokens: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``tokens`` of one key, ascending, with that key; the keys of the others, one for each pair; and those others, ascending."""
    if not len(tokens):
        return tokens, keys, keys, tokens
    order = np.argsort(tokens)
    tokens, keys = tokens[order], keys[order]
    starts = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
    low = np.minimum.reduceat(keys, starts)
    one = low == np.maximum.reduceat(keys, starts)
    several = np.repeat(~one, np.diff(np.append(starts, len(tokens))))
    more, theirs = tokens[several], keys[several]
    order = np.lexsort((theirs, more))
    more, theirs = more[order], theirs[order]
    fresh = np.append(True, (more[1:] != more[:-1]) | (theirs[1:] != theirs[:-1]))[: len(more)]
    return tokens[starts][one], low[one], theirs[fresh], tokens[starts][~one]


def likely_texts(texts: DataFrame, threshold: float) -> DataFrame:
    """Different ``key`` of those ``texts`` (key, gate, text) that may be similar to one of another key.

    A text of n triples shares at least threshold x n of them with a similar one,
    so it has none if more than the others are found under no other key. Every
    task sorts its triples by hash and hands out what it has under one key, with
    that key, and once what it has under several. Parts of all hashes are in
    proportion to the table.
    """
    t = float(threshold)
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(total / PART_BYTES))
    bounds = np.array([(i << 64) // parts for i in range(1, parts)], dtype=np.uint64)

    def block(rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        keys, inverse = np.unique(np.array([row[0] for row in rows], dtype=np.int64), return_inverse=True)
        gates = np.array([row[1] for row in rows], dtype=np.int64).view(np.uint64)
        tokens, owner = triples_of([row[2] for row in rows])
        tokens, owner = _mixed(tokens ^ gates[owner]), inverse[owner]
        tokens, low, owner, several = _by_hash(tokens, owner)
        n = np.bincount(low, minlength=len(keys)) + np.bincount(owner, minlength=len(keys))
        spare = n - np.ceil(t * n - 1e-9).astype(np.int64)
        owner = keys[low]
        cuts, more_cuts = np.searchsorted(tokens, bounds), np.searchsorted(several, bounds)
        columns = [
            [*range(parts), -1 - int(keys[0] % parts)],
            [part.tobytes() for part in [*np.split(tokens, cuts), spare]],
            [part.tobytes() for part in [*np.split(owner, cuts), keys]],
            [*(part.tobytes() for part in np.split(several, more_cuts)), b""],
        ]
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["part", "tokens", "keys", "several"]
        )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for key, gate, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                rows.append((key.as_py(), gate.as_py(), raw))
                held += len(raw)
                if held >= BLOCK_BYTES:
                    yield from block(rows)
                    rows, held = [], 0
        if rows:
            yield from block(rows)

    def counted(part: tuple, table: pa.Table) -> pa.Table:
        def values(name: str, kind: type) -> np.ndarray:
            return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in table.column(name))])

        keys = values("keys", np.int64)
        if part[0].as_py() < 0:
            spare = values("tokens", np.int64)
            return pa.table({"key": keys, "own": np.zeros(len(keys), np.int64), "spare": spare})
        tokens, keys, _, _ = _by_hash(values("tokens", np.uint64), keys)
        several = np.unique(values("several", np.uint64))
        own = np.ones(len(tokens), dtype=bool)
        if len(several):
            own = several[np.minimum(np.searchsorted(several, tokens), len(several) - 1)] != tokens
        found, n = np.unique(keys[own], return_counts=True)
        return pa.table({"key": found, "own": n.astype(np.int64), "spare": np.full(len(found), -1, np.int64)})

    dealt = texts.select("key", F.xxhash64("gate").alias("gate"), "text").mapInArrow(
        blocks, "part long, tokens binary, keys binary, several binary"
    )
    counts = dealt.groupBy("part").applyInArrow(counted, "key long, own long, spare long")
    sums = counts.groupBy("key").agg(F.sum("own").alias("own"), F.max("spare").alias("spare"))
    return sums.where("own <= spare").select("key")


def connected_groups(edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, group_id) for the nodes of ``edges`` (id, leader); group_id is the smallest id.

    Labels travel along the edges and then jump to the label of their label, so
    long chains close in a logarithmic number of rounds.
    """
    edges = staged(edges.distinct(), "edges")
    nodes = edges.select("id").unionAll(edges.select(F.col("leader").alias("id"))).distinct()
    labels = staged(nodes.withColumn("label", F.col("id")), "labels")
    sizes = staged(edges.groupBy("leader").agg(F.count("*").alias("n_rows")), "degrees")
    spark = edges.sparkSession
    while True:
        # What a round has staged goes with it, but for its labels.
        with cleared(spark) as scope:
            labels = scope.keep(_spread(edges, labels, sizes, hot_rows))
        if labels.where(F.col("label") != F.col("old")).isEmpty():
            return labels.select("id", F.col("label").alias("group_id"))
        labels = labels.drop("old")


def _spread(edges: DataFrame, labels: DataFrame, sizes: DataFrame, hot_rows: int) -> DataFrame:
    """One round: the least label among the neighbours, then the label of that label."""
    up = edges.join(labels, "id").groupBy(F.col("leader").alias("id")).agg(F.min("label").alias("up"))
    led = labels.withColumnsRenamed({"id": "leader", "label": "leader_label"}).join(sizes, "leader")
    down = (
        attach_group(edges, led, ["leader"], "inner", hot_rows=hot_rows)
        .groupBy("id")
        .agg(F.min("leader_label").alias("down"))
    )
    moved = staged(
        labels.join(up, "id", "left")
        .join(down, "id", "left")
        .select("id", F.col("label").alias("old"), F.least("label", "up", "down").alias("label")),
        "moved",
    )
    per_label = moved.groupBy("label").agg(F.count("*").alias("n_rows"))
    roots = moved.select(F.col("id").alias("label"), F.col("label").alias("root")).join(per_label, "label")
    return staged(
        attach_group(moved, roots, ["label"], hot_rows=hot_rows).select(
            "id", F.coalesce("root", "label").alias("label"), "old"
        ),
        "labels",
    )


def _length_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double") + 1e-9) / math.log(RATIO)).cast("int")


def _least(share: Column) -> Column:
    """The smallest whole number that is not below ``share``."""
    return F.ceil(share - 1e-9).cast("int")


def meeting_points(texts: DataFrame, threshold: float, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(bucket, as_longer, id, n, rest) under which texts (id, gate, shingles) may meet a similar one.

    Of two texts the longer one looks (``as_longer``) where the shorter one lies.
    A text of n triples has a triple in common with a similar one among its first
    n - least common + 1; ``rest`` counts its triples from that one on. The least
    common number is threshold x n for the longer text, and for the shorter one
    what two texts of its length need.
    """
    rows = texts.select("id", F.size("shingles").alias("n"), "gate", F.explode("shingles").alias("shingle"))
    rows = rows.select("id", "n", F.xxhash64("gate", "shingle").alias("token"))
    often = rows.groupBy("token").agg(F.count("*").alias("n_rows")).where("n_rows > 1")
    shared = attach_group(rows, often, ["token"], "inner", hot_rows=hot_rows)
    mine = Window.partitionBy("id")
    # Triples of no other text come first of all.
    place = F.col("n") - F.count("*").over(mine) + F.row_number().over(mine.orderBy("n_rows", "token"))
    placed = shared.withColumn("rest", F.col("n") - place + 1)
    t = float(threshold)
    placed = placed.where(F.col("rest") >= _least(t * F.col("n"))).select("id", "n", "token", "rest")
    # With ``rest`` of its triples left a text can be similar to texts up to this length.
    most = F.floor(F.col("rest") * (1 + t) / t - F.col("n") + 1e-9)
    lying = placed.where(most >= F.col("n")).select(
        F.xxhash64("token", _length_class(F.col("n"))).alias("bucket"), F.lit(False).alias("as_longer"), "id", "n", "rest"
    )
    shortest, longest = _least(t * F.col("n")), F.least("n", most)
    classes = F.sequence(_length_class(shortest), _length_class(longest))
    looking = placed.where(longest >= shortest).select("id", "n", "rest", "token", F.explode(classes).alias("c"))
    looking = looking.select(F.xxhash64("token", "c").alias("bucket"), F.lit(True).alias("as_longer"), "id", "n", "rest")
    return lying.unionAll(looking)


def _possible(threshold: float, price_tolerance: float | None) -> Column:
    """Whether a longer text (id, n, rest, price) may be similar to a shorter one (other_...)."""
    t = float(threshold)
    n, other = F.col("n"), F.col("other_n")
    good = (other <= n) & (other >= t * n - 1e-9) & ((other < n) | (F.col("id") > F.col("other_id")))
    good = good & (F.least("rest", "other_rest") >= (n + other) * t / (1 + t) - 1e-9)
    return good & _near_price(price_tolerance)


def _near_price(price_tolerance: float | None) -> Column:
    if price_tolerance is None:
        return F.lit(True)
    spread = F.abs(F.col("price") - F.col("other_price"))
    near = spread <= F.greatest(F.abs("price"), F.abs("other_price")) * price_tolerance
    return F.coalesce(near, F.lit(False)) | (F.col("price").isNull() & F.col("other_price").isNull())


def _confirmed(pairs: DataFrame, texts: DataFrame, threshold: float, hot_rows: int) -> DataFrame:
    """Those (id, other_id) of ``pairs`` whose sets are similar, as links (id, leader), leader the smaller id."""
    pairs = staged(pairs.select("id", "other_id").distinct(), "pairs")
    sizes = pairs.groupBy("other_id").agg(F.count("*").alias("n_rows"))
    theirs = texts.select(F.col("id").alias("other_id"), F.col("shingles").alias("other_shingles"))
    joined = salted_join(pairs.join(texts.select("id", "shingles"), "id"), theirs, sizes, ["other_id"], hot_rows=hot_rows)
    good = joined.where(jaccard(F.col("shingles"), F.col("other_shingles")) >= threshold)
    return staged(good.select(F.greatest("id", "other_id").alias("id"), F.least("id", "other_id").alias("leader")), "links")


def near_links(
    texts: DataFrame, threshold: float, price_tolerance: float | None, hot_rows: int = HOT_ROWS, few: int = FEW
) -> DataFrame:
    """Confirmed (id, leader) links among ``texts`` (id, gate, price, shingles) that connect all that are similar."""
    points = staged(meeting_points(texts, threshold, hot_rows), "points")
    sides = points.groupBy("bucket").agg(
        F.count("*").alias("n_rows"),
        F.count_if("as_longer").alias("lookers"),
        F.count_if(~F.col("as_longer")).alias("liers"),
        F.min(F.when(~F.col("as_longer"), F.col("id"))).alias("leader"),
    )
    sides = sides.where("lookers > 0 and liers > 0 and n_rows > 2")
    crowded = F.least("lookers", "liers") > few
    met = attach_group(points, sides.withColumn("crowded", crowded).drop("lookers", "liers"), ["bucket"], "inner", hot_rows=hot_rows)
    met = staged(met.join(texts.select("id", "price"), "id"), "met")
    # Everybody in a crowd and the smallest id that lies there.
    crowds = met.where("crowded")
    led = crowds.where(F.col("id") != F.col("leader")).select("id", F.col("leader").alias("other_id")).distinct()
    prices = texts.select(F.col("id").alias("other_id"), F.col("price").alias("other_price"), F.size("shingles").alias("other_n"))
    led = led.join(texts.select("id", "price", F.size("shingles").alias("n")), "id").join(prices, "other_id")
    as_long = F.least("n", "other_n") >= F.greatest("n", "other_n") * threshold - 1e-9
    first = _confirmed(led.where(as_long & _near_price(price_tolerance)), texts, threshold, hot_rows)
    groups = staged(connected_groups(first, hot_rows), "classes")
    rows = met.join(groups, "id", "left").withColumn("class", F.coalesce("group_id", "id"))
    rows = staged(rows.select("bucket", "as_longer", "crowded", "id", "n", "rest", "price", "class"), "rows")
    other = rows.where("not as_longer").drop("as_longer", "crowded")
    other = other.withColumnsRenamed({c: f"other_{c}" for c in ("id", "n", "rest", "price", "class")})
    possible = _possible(threshold, price_tolerance) & (F.col("class") != F.col("other_class"))
    small = rows.where("as_longer and not crowded").join(other, "bucket").where(possible)
    # In a crowd only what lies outside its largest class has pairs that are not known yet.
    per_class = rows.where("crowded").groupBy("bucket", "class").agg(F.count("*").alias("n"))
    major = per_class.groupBy("bucket").agg(F.max(F.struct("n", "class")).alias("most"), F.count("*").alias("classes"))
    major = major.where("classes > 1").select("bucket", F.col("most.class").alias("major"))
    mixed = rows.where("crowded").join(major, "bucket")
    liers = other.join(major, "bucket")
    minor = liers.where(F.col("other_class") != F.col("major")).drop("major")
    outside = mixed.where("as_longer and class != major").drop("major").join(liers.drop("major"), "bucket").where(possible)
    inside = mixed.where("as_longer and class = major").drop("major").join(minor, "bucket").where(possible)
    pairs = reduce(DataFrame.unionAll, [p.select("id", "other_id") for p in (small, outside, inside)])
    return first.unionAll(_confirmed(pairs, texts, threshold, hot_rows))


def near_duplicates(
    bids: DataFrame,
    threshold: float = 0.8,
    route: Sequence[str] = ("load_location", "unload_location"),
    price_tolerance: float | None = 0.1,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Every bid with ``group_id`` (its smallest near duplicate) and ``is_near_duplicate``.

    Two bids are linked only on the same route (NULL equals NULL) and with prices
    within the tolerance. Exact copies are folded first: they need no comparison.
    """
    # The title names source and item, so it only speaks where there is no text.
    words = tokens(F.coalesce(F.nullif("description", F.lit("")), "title"))
    rows = bids.select(
        "id",
        F.to_json(F.struct(*[F.lower(F.col(c)).alias(c) for c in route])).alias("gate"),
        F.col("price_value").alias("price"),
        F.array_join(words, " ").alias("text"),
    )
    folded = F.sha2(F.to_json(F.struct("gate", "price", "text")), 256)
    keyed = staged(rows.withColumn("copy", folded).withColumn("key", F.xxhash64("copy")), "texts")
    copies = staged(keyed.groupBy("copy").agg(F.count("*").alias("n_rows"), F.min("id").alias("rep")), "copies")
    likely = staged(likely_texts(keyed, threshold), "likely")
    # The same text has the same words in all its copies.
    texts = keyed.join(likely, "key", "left_semi").groupBy("copy").agg(
        F.min("id").alias("id"), F.first("gate").alias("gate"), F.first("price").alias("price"), F.first("text").alias("text")
    )
    no_words = F.array().cast("array<string>")
    split = F.when(F.col("text") != "", F.split("text", " ")).otherwise(no_words)
    texts = staged(texts.select("id", "gate", "price", split.alias("words")), "words")
    texts = staged(texts.select("id", "gate", "price", shingles(F.col("words")).alias("shingles")), "shingles")
    groups = connected_groups(near_links(texts, threshold, price_tolerance, hot_rows), hot_rows)
    named = copies.select("copy", "n_rows", "rep").join(groups.withColumnRenamed("id", "rep"), "rep", "left")
    named = named.select("copy", "n_rows", F.coalesce("group_id", "rep").alias("group_id"))
    return attach_group(keyed.select("id", "copy"), named, ["copy"], "inner", hot_rows=hot_rows).select(
        "id", "group_id", (F.col("id") != F.col("group_id")).alias("is_near_duplicate")
    )
