"""Near duplicates by Order MinHash and banded alignment.

The k-mers of a text are its runs of five words, each labelled with how often it
came before. A sketch takes the two k-mers with the smallest hashes and keeps
them in the order of the text, so it changes with the order as well as with the
content. Texts that share a sketch meet in a bucket and are compared with its
leader, the smallest id.

Texts with many small changes have few runs of five words in common, and texts
around a frequent passage meet the wrong leaders. So classes meet once more, by
single words: each of several minimum hashes draws one word of a text, and all
texts of a bucket meet that are of different classes. Buckets of at most ``FEW``
texts give their pairs at once. The others, crowds, are told apart by more of the
words that follow the drawn one, and who is in a crowd to the end is compared
with its leader: that links most of them in few pairs. Whoever is in different
classes then is compared pair by pair, whatever follows the drawn word, all but
the pairs inside a crowd's largest class, in blocks of ``BLOCK`` texts: no task
holds more of a crowd. Pairs are those that have about the same length and whose
draws agree often enough.

Every link is confirmed by a banded alignment of whole texts, and classes are
the connected parts of the links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidflow.llm.common import BASE, bounded_batches, flat, mixed, pieces, word_hashes
from bidflow.operators.near import connected_groups
from bidflow.operators.skew import attach_group, salted_join
from bidflow.shared import cleared, staged

WORDS = 5
SKETCHES = 32
KMERS = 2
SIMILARITY = 0.8
# Words drawn from a text; the first of them make buckets, with so many words from the drawn one on in each step.
DRAWS = 64
BUCKETS = 32
STEPS = (2, 8)
# Buckets of so many texts give their pairs; words that occur no more often than this are buckets by themselves.
FEW = 64
# Texts of a crowd that are compared in one piece, and how many of them at a time.
BLOCK = 4096
ROWS = 64
# Of 64 draws of alike texts 44 agree on average (two thirds, and by chance); fewer than this are one in five thousand.
AGREEING = 31
BINS = 1 << 20
# Bits that tell whether an id may be among others, a power of two, and longs of bits that tell two texts' words apart, most and fewest.
ID_BITS = 1 << 24
PARITY_LONGS = 64
FEWEST_LONGS = 8
SLICE = 1 << 14
# Alignments of texts up to this length keep whole rows of bits, longer ones the part inside the band.
WHOLE_ROWS = 1 << 12
# Texts with so many words of a window to align by place, each; more are kept as bits.
PLACES = 64
# A leader of more pairs than this is copied.
HOT_PAIRS = 20_000
_RNG = np.random.default_rng(20251204)


def _draws(n: int) -> tuple[np.ndarray, np.ndarray]:
    turn = _RNG.integers(0, 1 << 63, size=n, dtype=np.uint64)[:, None]
    return turn, (_RNG.integers(0, 1 << 63, size=n, dtype=np.uint64) | np.uint64(1))[:, None]


_TURN, _SCALE = _draws(SKETCHES)
_WORD_TURN, _WORD_SCALE = _draws(DRAWS)


def text_id(text: Column) -> Column:
    """Equal texts have equal ids; a null text is an empty one."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def labelled(h: np.ndarray) -> np.ndarray:
    """Hashes that also tell how often each of ``h`` came before."""
    order = np.argsort(h, kind="stable")
    run = np.append(True, h[order][1:] != h[order][:-1])
    first = np.maximum.accumulate(np.where(run, np.arange(len(h)), 0))
    nth = np.empty(len(h), dtype=np.uint64)
    nth[order] = (np.arange(len(h)) - first).astype(np.uint64)
    with np.errstate(over="ignore"):
        return mixed(h + nth * np.uint64(0x9E3779B97F4A7C15))


def kmers(words: np.ndarray) -> np.ndarray:
    """Occurrence-labelled hashes of all runs of five words (of the whole text if it is shorter)."""
    if not len(words):
        return words
    size = min(WORDS, len(words))
    with np.errstate(over="ignore"):
        h = np.zeros(len(words) - size + 1, dtype=np.uint64)
        for j in range(size):
            h = h * np.uint64(BASE) + words[j : len(words) - size + 1 + j]
        return labelled(mixed(h ^ np.uint64(size)))


def sketches(words: np.ndarray) -> np.ndarray:
    """SKETCHES hashes of the smallest k-mers in text order; none for a text without words."""
    h = kmers(words)
    if not len(h):
        return np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        best = None
        for low in range(0, len(h), SLICE):
            own = (h[low : low + SLICE][None, :] ^ _TURN) * _SCALE
            own ^= own >> np.uint64(32)
            keep = min(KMERS, own.shape[1])
            at = np.argpartition(own, keep - 1, axis=1)[:, :keep]
            found = (np.take_along_axis(own, at, 1), at + low)
            if best is not None:
                found = tuple(np.concatenate([a, b], axis=1) for a, b in zip(best, found, strict=True))
                at = np.argpartition(found[0], min(KMERS, found[0].shape[1]) - 1, axis=1)[:, :KMERS]
                found = tuple(np.take_along_axis(x, at, 1) for x in found)
            best = found
        places = np.sort(best[1], axis=1)
        out = _TURN[:, 0].copy()
        for j in range(places.shape[1]):
            out = mixed(out * np.uint64(BASE) + h[places[:, j]])
    return out.view(np.int64)


def drawn(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the words of a text that the draws take, the ``nth`` occurrence of a word being a word of its own."""
    own = labelled(words)
    least, at = np.full(DRAWS, np.iinfo(np.uint64).max, dtype=np.uint64), np.zeros(DRAWS, dtype=np.int64)
    with np.errstate(over="ignore"):
        for low in range(0, len(own), SLICE):
            h = (own[low : low + SLICE][None, :] ^ _WORD_TURN) * _WORD_SCALE
            h ^= h >> np.uint64(32)
            here = h.argmin(axis=1)
            value = h[np.arange(DRAWS), here]
            at = np.where(value < least, here + low, at)
            least = np.minimum(least, value)
    return at, own[at]


def bucket_keys(words: np.ndarray, ends: np.ndarray, at: np.ndarray, own: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For places ``at`` of ``words`` (texts end at ``ends``) one 32-bit key for each step, to be used one after the other.

    The first is of the word itself where it is rare. Past its end a text goes on with a word of no text.
    """
    with np.errstate(over="ignore"):
        h, keys = own, []
        for j in range(1, STEPS[-1]):
            place = at + j
            h = mixed(h * np.uint64(BASE) + np.where(place < ends, words[np.minimum(place, len(words) - 1)], np.uint64(0)))
            if j + 1 in STEPS:
                keys.append((h >> np.uint64(32)).astype(np.uint32))
        rare = ~common[words[at] % np.uint64(BINS)]
        keys[0] = np.where(rare, (own >> np.uint64(32)).astype(np.uint32), keys[0])
    return np.stack(keys, axis=1).view(np.int32)


def signature(own: np.ndarray) -> np.ndarray:
    """Four bits of each of a text's draws, 16 to a long."""
    with np.errstate(over="ignore"):
        bits = mixed(own + _WORD_TURN[:, 0]) & np.uint64(15)
    return (bits.reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64).view(np.int64)


def read_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words, ends): those of all texts of ``column``, as ``worded`` wrote them, and where each text ends."""
    parts = [np.frombuffer(text.as_buffer(), np.uint32) for text in column]
    words = np.concatenate([np.zeros(0, np.uint32), *parts]).astype(np.uint64)
    return words, np.cumsum([len(part) for part in parts], dtype=np.int64)


def common_words(texts: DataFrame) -> np.ndarray:
    """Whether the words of a bin occur more than ``FEW`` times in ``texts`` (words); BINS flags."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BINS, dtype=np.int64)
        for batch in pieces(batches, "words"):
            words, _ = read_words(batch.column("words"))
            n += np.bincount((words % np.uint64(BINS)).astype(np.int64), minlength=BINS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["bin", "n"])

    counts = texts.select("words").mapInArrow(count, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n"))
    out = np.zeros(BINS, dtype=bool)
    out[counts.where(F.col("n") > FEW).select("bin").toArrow()["bin"].to_numpy()] = True
    return out


def of_ids(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, words) of the different ``texts`` that have an id of ``ids``.

    Only texts whose id may be one of them, by a bit of its hash, are shuffled.
    """
    place = F.pmod("id", F.lit(ID_BITS))
    bits = ids.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(id & 63 as int))")).alias("bits"))
    found = bits.toArrow()
    flags = np.zeros(ID_BITS >> 6, dtype=np.uint64)
    flags[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("id").to_numpy().view(np.uint64) % np.uint64(ID_BITS)
            yield batch.filter(pa.array((flags[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)))

    some = texts.select("id", "words").mapInArrow(maybe, "id bigint, words binary")
    return some.join(ids, "id", "left_semi").dropDuplicates(["id"])


def parities(words: np.ndarray) -> np.ndarray:
    """For each of some bins, whether an odd number of a text's words (repeats told apart) is in it, 64 to a long.

    A word that only one of two texts has changes one bin: they differ in no fewer words than bins.
    """
    bins = (labelled(words) % np.uint64(64 * PARITY_LONGS)).astype(np.int64)
    odd = np.bincount(bins, minlength=64 * PARITY_LONGS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def fold(found: np.ndarray, longs: int) -> np.ndarray:
    """Parities (one text each row) of fewer bins: those that are the same modulo that number become one."""
    return np.bitwise_xor.reduce(found.reshape(len(found), -1, longs), axis=1)


def fitted(words: np.ndarray) -> np.ndarray:
    """The parities of a text in four to eight bins for each word, as far as there are bounds."""
    longs = min(max(1 << (len(words) // 16).bit_length(), FEWEST_LONGS), PARITY_LONGS)
    return fold(parities(words)[None, :], longs)[0]


def folded(found: list[np.ndarray]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """(longs, parities by longs): how many longs each of ``found`` has, and for each number all that have as many or more, folded to it."""
    longs = np.array([len(part) for part in found], dtype=np.int64)
    out = {}
    for few in np.unique(longs).tolist():
        out[few] = np.zeros((len(found), few), dtype=np.uint64)
        for many in np.unique(longs[longs >= few]).tolist():
            at = np.flatnonzero(longs == many)
            out[few][at] = fold(np.stack([found[i] for i in at.tolist()]), few)
    return longs, out


def matches_in_band(a: np.ndarray, b: np.ndarray, width: int) -> int:
    """Length of the longest common subsequence within ``width`` places of the diagonal.

    One row of bits for the places of ``a`` in a window that moves with the place
    in ``b``. Bits that leave it are final, since a match only changes bits from
    its own place on. A word's places are made bits for its row; only words that
    are frequent in a stretch of the window's size are kept as bits.
    """
    size = 2 * width + 1
    full = (1 << size) - 1
    stretches: dict[int, tuple[np.ndarray, np.ndarray, dict[int, int]]] = {}

    def bits(word: int, stretch: int) -> int:
        if stretch < 0 or stretch * size >= len(a):
            return 0
        if stretch not in stretches:
            for old in [s for s in stretches if s < stretch - 1]:
                del stretches[old]
            part = a[stretch * size : (stretch + 1) * size]
            order = np.argsort(part, kind="stable")
            stretches[stretch] = (part[order], order, {})
        values, order, kept = stretches[stretch]
        if word in kept:
            return kept[word]
        first, last = np.searchsorted(values, [word, word + 1])
        if first == last:
            return 0
        if last - first == 1:
            return 1 << int(order[first])
        flags = np.zeros(int(order[last - 1]) + 1, dtype=np.uint8)
        flags[order[first:last]] = 1
        made = int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")
        if last - first > PLACES:
            kept[word] = made
        return made

    row, matched = full, 0
    for j, word in enumerate(b.tolist()):
        low = j - width
        stretch, skip = divmod(low, size)
        there = bits(word, stretch) >> skip
        if skip:
            there |= (bits(word, stretch + 1) << (size - skip)) & full
        hit = row & there
        if hit:
            row = ((row + hit) | (row - hit)) & full
        matched += not row & 1
        row = (row >> 1) | (1 << (size - 1))
    return matched + size - row.bit_count()


def words_in_common(a: np.ndarray, b: np.ndarray) -> int:
    """How many words two texts have in common, in any order: no alignment has more."""
    values, counts = np.unique(a, return_counts=True)
    others, other_counts = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(values, others, assume_unique=True, return_indices=True)
    return int(np.minimum(counts[i], other_counts[j]).sum())


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> float:
    """Share of the longer text's words that align with the other's in order; 0 where it is surely below ``similarity``.

    A longest common subsequence, one row of bits at a time, inside the band of
    diagonals that an alignment good enough cannot leave. Memory is in
    proportion to the words.
    """
    longer = max(len(a), len(b))
    if not longer or min(len(a), len(b)) < similarity * longer:
        return 0.0
    if words_in_common(a, b) < similarity * longer - 1e-9:
        return 0.0
    width = int((1 - similarity) * longer) + 1
    same = a[: min(len(a), len(b))] == b[: min(len(a), len(b))]
    head = int(same.argmin()) if not same.all() else len(same)
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    same = a[len(a) - n :][::-1] == b[len(b) - n :][::-1]
    tail = (int(same.argmin()) if not same.all() else n) if n else 0
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    common = head + tail
    if len(a) > WHOLE_ROWS:
        common += matches_in_band(a, b, width) if len(b) else 0
    elif len(a) and len(b):
        places: dict[int, int] = {}
        wanted = set(b.tolist())
        for i, w in enumerate(a.tolist()):
            if w in wanted:
                places[w] = places.get(w, 0) | 1 << i
        full = (1 << len(a)) - 1
        band = (1 << (2 * width + 1)) - 1
        row = full
        for j, w in enumerate(b.tolist()):
            there = places.get(w)
            if there is not None:
                hit = row & there & (band << (j - width) if j > width else band >> (width - j))
                row = ((row + hit) | (row - hit)) & full
        common += len(a) - row.bit_count()
    return common / longer


TEXTS = "id bigint, n int, words binary"
TEXT_COLUMNS = ("id", "n", "words")


def worded(docs: DataFrame) -> DataFrame:
    """Every text with words: id, n, and words as 32-bit hashes. Copies are left in: what is made of a
    text's words is smaller than they are, and folded by id before it is shuffled."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            h, counts, _ = word_hashes(*flat(batch.column("text")))
            some = np.flatnonzero(counts)
            small = (h >> np.uint64(32)).astype(np.uint32)
            parts = [part.tobytes() for part in np.split(small, np.cumsum(counts)[some][:-1])] if len(some) else []
            columns = [batch.column("id").take(pa.array(some)), pa.array(counts[some].astype(np.int32)), pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "words"])

    return docs.select(text_id(F.col("text")).alias("id"), "text").mapInArrow(hashed, TEXTS)


def sketched(texts: DataFrame) -> DataFrame:
    """(id, n, sketches) of the different ``texts``."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "words"):
            words, ends = read_words(batch.column("words"))
            found = [sketches(own) for own in np.split(words, ends[:-1])] if len(ends) else []
            columns = [batch.column("id"), batch.column("n"), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "sketches"])

    return texts.select(*TEXT_COLUMNS).mapInArrow(sketch, "id bigint, n int, sketches array<bigint>").dropDuplicates(["id"])


def drawn_from(texts: DataFrame) -> DataFrame:
    """(id, n, keys, near, parities) of the different ``texts``: the keys of the draws that make buckets, the signature of
    all draws, and the parities of all words, as many as fit their number."""
    common = np.packbits(common_words(texts))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.unpackbits(common).astype(bool)
        for batch in pieces(batches, "words"):
            words, ends = read_words(batch.column("words"))
            places, owns, near, bins = [], [], [], []
            for low, high in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=False):
                at, own = drawn(words[low:high])
                places.append(at[:BUCKETS] + low)
                owns.append(own[:BUCKETS])
                near.append(signature(own))
                bins.append(fitted(words[low:high]).tobytes())
            keys: list = []
            if near:
                found = bucket_keys(words, np.repeat(ends, BUCKETS), np.concatenate(places), np.concatenate(owns), often)
                keys = list(found.reshape(len(near), -1))
            columns = [batch.column("id"), batch.column("n"), pa.array(keys, pa.list_(pa.int32())), pa.array(near, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(bins, pa.binary())], names=["id", "n", "keys", "near", "parities"])

    made = "id bigint, n int, keys array<int>, near array<bigint>, parities binary"
    return texts.select(*TEXT_COLUMNS).mapInArrow(draw, made).dropDuplicates(["id"])


def confirmed(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those (id, leader) of ``pairs`` whose texts align."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "words"):
            both = zip(batch.column("words"), batch.column("leader_words"), strict=True)
            good = [
                aligned(np.frombuffer(a.as_py(), np.uint32), np.frombuffer(b.as_py(), np.uint32), similarity) >= similarity
                for a, b in both
            ]
            yield batch.select(["id", "leader"]).filter(pa.array(good, pa.bool_()))

    ids = pairs.select("id").unionAll(pairs.select("leader")).distinct()
    words = staged(of_ids(texts, ids), "near-words")
    sizes = pairs.groupBy("leader").agg(F.count("*").alias("n_rows"))
    theirs = words.withColumnsRenamed({"id": "leader", "words": "leader_words"})
    joined = salted_join(pairs.join(words, "id"), theirs, staged(sizes, "near-leaders"), ["leader"], hot_rows=HOT_PAIRS)
    return joined.select("id", "leader", "words", "leader_words").mapInArrow(align, "id bigint, leader bigint")


def about_as_long(n: Column, other: Column, similarity: float) -> Column:
    return F.least(n, other) >= similarity * F.greatest(n, other) - 1e-9


def agree(near: Column, other: Column) -> Column:
    """How many of the draws of two texts agree, by their signatures."""

    def differ(i: int) -> Column:
        x = F.get(near, F.lit(i)).bitwiseXOR(F.get(other, F.lit(i)))
        any_bit = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(any_bit, 2))
        return F.bit_count(any_bit.bitwiseAND(F.lit(0x1111111111111111)))

    return DRAWS - reduce(Column.__add__, [differ(i) for i in range(DRAWS // 16)])


def alike_in(rows: dict, left: np.ndarray, right: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The (ids, other ids) of a cell of a crowd that may be alike: of ``rows`` those at ``left`` meet those at ``right``,
    ``ROWS`` of them at a time.

    Two outside the largest class (``major``) meet twice and count once. Texts that surely differ in too many words are no
    pairs: in a crowd around a passage most agree in about as many draws as alike ones do.
    """
    ids, sizes, kinds, near = rows["id"], rows["n"], rows["class"], rows["near"]
    longs, bins = folded(rows["parities"])
    left, right = (side[np.argsort(sizes[side], kind="stable")] for side in (left, right))
    lengths = sizes[right]
    for at in range(0, len(left), ROWS):
        own = left[at : at + ROWS]
        # Lengths are whole: what is left out is too short or too long for each of them.
        low = np.searchsorted(lengths, np.floor(sizes[own[0]] * similarity - 1e-6))
        high = np.searchsorted(lengths, np.ceil(sizes[own[-1]] / similarity + 1e-6), side="right")
        others = right[low:high]
        differ = np.zeros((len(own), len(others)), dtype=np.uint8)
        for i in range(DRAWS // 16):
            x = near[own, i][:, None] ^ near[others, i][None, :]
            x |= x >> np.uint64(1)
            x |= x >> np.uint64(2)
            differ += np.bitwise_count(x & np.uint64(0x1111111111111111))
        good = (differ <= DRAWS - AGREEING) & (kinds[own][:, None] != kinds[others][None, :])
        good &= rows["major"][others][None, :] | (ids[own][:, None] > ids[others][None, :])
        a, b = np.nonzero(good)
        a, b = own[a], others[b]
        long = np.maximum(sizes[a], sizes[b])
        some = np.minimum(sizes[a], sizes[b]) >= similarity * long - 1e-9
        most = sizes[a] + sizes[b] - 2 * similarity * long + 1e-6
        fewer = np.minimum(longs[a], longs[b])
        for few, of in bins.items():
            these = np.flatnonzero(some & (fewer == few))
            for cut in range(0, len(these), SLICE):
                pairs = these[cut : cut + SLICE]
                changed = np.bitwise_count(of[a[pairs]] ^ of[b[pairs]]).sum(axis=1, dtype=np.int64)
                some[pairs] = changed <= most[pairs]
        yield ids[a[some]], ids[b[some]]


def pairs_of_sketches(texts: DataFrame, similarity: float) -> DataFrame:
    """(id, leader) for texts that share a sketch with a leader of about the same length."""
    known = staged(sketched(texts), "near-sketches")
    lengths = known.select("id", "n")
    # All texts are dealt to all their buckets by id only; lengths come to those that meet.
    rows = known.select("id", F.posexplode("sketches").alias("place", "sketch"))
    rows = rows.select("id", F.xxhash64("place", "sketch").alias("bucket"))
    leaders = rows.groupBy("bucket").agg(F.min("id").alias("leader"), F.count("*").alias("n_rows")).where("n_rows > 1")
    leaders = leaders.join(lengths.withColumnsRenamed({"id": "leader", "n": "leader_n"}), "leader")
    met = attach_group(rows, leaders, ["bucket"], "inner").where(F.col("id") != F.col("leader"))
    met = met.select("id", "leader", "leader_n").distinct().join(lengths, "id")
    return met.where(about_as_long(F.col("n"), F.col("leader_n"), similarity)).select("id", "leader")


def pairs_of_draws(known: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(id, leader) for texts of different classes that share a drawn word, and the crowds (bucket, id) around such a word
    of which these pairs hold those only that share as many of the words that follow as it takes to tell them apart."""
    steps = len(STEPS)
    names = ("id", "n", "near", "class")
    # The first step deals all texts to all their buckets: by id and class only, what else is known of those that meet follows.
    first_keys = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda i: F.xxhash64(i, F.get("keys", i * steps)))
    rows = known.select("id", "class", F.posexplode(first_keys).alias("place", "bucket"))
    buckets = rows.groupBy("bucket").agg(F.count("*").alias("n_rows"), F.min("class").alias("low"), F.max("class").alias("high"))
    # Nested buckets: who is alone, or with its own class, stays so.
    buckets = buckets.where("low < high").select("bucket", "n_rows")
    met = staged(attach_group(rows.drop("class"), buckets, ["bucket"], "inner"), "near-met")
    few = met.where(F.col("n_rows") <= FEW).select("id", "bucket").join(known.select(*names), "id")
    found = [_alike(pairs_of_few(few), similarity)]
    rest = F.slice("keys", F.col("place") * steps + 2, steps - 1).alias("rest")
    crowd = met.where(F.col("n_rows") > FEW).select("id", "place", "bucket").join(known, "id").select(*names, "bucket", rest)
    crowd = staged(crowd, "near-crowd")
    # Who is told apart below has met the others of its first bucket no more: they meet by that one again.
    crowds = crowd.select("bucket", "id")
    rows = crowd.withColumn("bucket", F.xxhash64("bucket", F.get("rest", F.lit(0))))
    for step in range(1, steps):
        first = F.min(F.struct("id", "n", "near", "class")).alias("first")
        buckets = rows.groupBy("bucket").agg(
            F.count("*").alias("n_rows"), F.min("class").alias("low"), F.max("class").alias("high"), first
        )
        buckets = buckets.where("low < high").select("bucket", "n_rows", "first")
        if step + 1 < steps:
            buckets = buckets.drop("first")
        met = staged(attach_group(rows, buckets, ["bucket"], "inner"), "near-met")
        found.append(_alike(pairs_of_few(met.where(F.col("n_rows") <= FEW)), similarity))
        crowd = met.where(F.col("n_rows") > FEW)
        if step + 1 == steps:
            led = crowd.select(*names, *[F.col(f"first.{c}").alias(f"other_{c}") for c in names])
            found.append(_alike(led, similarity))
        else:
            rows = crowd.select(*names, F.xxhash64("bucket", F.get("rest", F.lit(step))).alias("bucket"), "rest")
    return reduce(DataFrame.unionAll, found).distinct(), crowds


def pairs_of_crowds(crowds: DataFrame, known: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """(id, leader) for the texts of ``crowds`` (bucket, id) that are of different classes (``groups``).

    Every text outside a crowd's largest class meets all others of the crowd, in cells of a block of those and one of all.
    """
    def met_in(cell: pa.Table) -> pa.Table:
        rows = {name: cell[name].to_numpy() for name in ("id", "class", "major")}
        rows["n"] = cell["n"].to_numpy().astype(np.int64)
        rows["near"] = cell["near"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(cell), -1)
        rows["parities"] = [np.frombuffer(part, np.uint64) for part in cell["parities"].to_pylist()]
        left, right = (np.flatnonzero(cell[side].to_numpy()) for side in ("is_left", "is_right"))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)), *alike_in(rows, left, right, similarity)]
        ids, others = (np.concatenate(side) for side in zip(*found, strict=True))
        return pa.table({"id": np.maximum(ids, others), "leader": np.minimum(ids, others)})

    kinds = F.coalesce("group_id", "id").alias("class")
    rows = staged(crowds.join(groups, "id", "left").select("bucket", "id", kinds), "near-crowds")
    kinds = rows.groupBy("bucket", "class").agg(F.count("*").alias("n_class"))
    sizes = kinds.groupBy("bucket").agg(
        F.sum("n_class").alias("n_rows"), F.max(F.struct("n_class", "class")).alias("most"), F.count("*").alias("n_classes")
    )
    sizes = sizes.where("n_classes > 1").select(
        "bucket",
        "n_rows",
        F.col("most.class").alias("largest"),
        F.ceil((F.col("n_rows") - F.col("most.n_class")) / BLOCK).alias("blocks"),
        F.ceil(F.col("n_rows") / BLOCK).alias("other_blocks"),
    )
    place = F.hash("id")
    met = attach_group(rows, sizes, ["bucket"], "inner").select(
        *("bucket", "id", "class", "blocks", "other_blocks"),
        (F.col("class") == F.col("largest")).alias("major"),
        F.pmod(place, F.col("blocks")).alias("block"),
        F.pmod(place, F.col("other_blocks")).alias("other_block"),
    )
    # Cells are numbered row by row: a block of texts outside the largest class, a column for a block of all.
    own = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("other_blocks") - 1), lambda j: F.col("block") * F.col("other_blocks") + j)
    own = F.when(F.col("major"), F.array().cast("array<bigint>")).otherwise(own)
    others = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda i: i * F.col("other_blocks") + F.col("other_block"))
    cells = met.withColumn("cell", F.explode(F.array_union(own, others)))
    cells = cells.select(
        *("bucket", "cell", "id", "class", "major"),
        (~F.col("major") & (F.floor(F.col("cell") / F.col("other_blocks")) == F.col("block"))).alias("is_left"),
        (F.col("cell") % F.col("other_blocks") == F.col("other_block")).alias("is_right"),
    )
    dealt = cells.join(known.select("id", "n", "near", "parities"), "id").groupBy("bucket", "cell")
    return dealt.applyInArrow(met_in, "id bigint, leader bigint").distinct()


def pairs_of_few(met: DataFrame) -> DataFrame:
    """The pairs of buckets with at most ``FEW`` rows; each row is shuffled once."""
    names = ("id", "n", "near", "class")
    members = met.groupBy("bucket").agg(F.collect_list(F.struct(*names)).alias("members"))
    firsts = members.select(F.explode("members").alias("a"), "members")
    later = F.filter("members", lambda b: b["id"] < F.col("a.id"))
    both = firsts.select("a.*", F.explode(later).alias("b"))
    return both.select(*names, *[F.col(f"b.{c}").alias(f"other_{c}") for c in names])


def _alike(met: DataFrame, similarity: float) -> DataFrame:
    """The pairs of ``met`` that may be alike."""
    good = (
        (F.col("class") != F.col("other_class"))
        & about_as_long(F.col("n"), F.col("other_n"), similarity)
        & (agree(F.col("near"), F.col("other_near")) >= AGREEING)
    )
    return met.where(good).select("id", F.col("other_id").alias("leader"))


def links(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Confirmed (id, leader) among the different texts of ``docs``: of sketches, and between the classes
    (id, group_id) of those, of drawn words and of what these leave in crowds."""
    bounded_batches(docs.sparkSession)
    texts = staged(worded(docs), "near-texts")

    def kept(make: Callable[[], DataFrame]) -> DataFrame:
        with cleared(docs.sparkSession) as scope:
            return scope.keep(staged(make(), "near-found"))

    pairs = kept(lambda: pairs_of_sketches(texts, similarity))
    found = kept(lambda: confirmed(pairs, texts, similarity))
    groups = kept(lambda: connected_groups(found))
    kinds = F.coalesce("group_id", "id").alias("class")
    known = kept(lambda: drawn_from(texts).join(groups, "id", "left").select("id", "n", "keys", "near", "parities", kinds))
    with cleared(docs.sparkSession) as scope:
        more, crowds = pairs_of_draws(known, similarity)
        more = scope.keep(staged(more, "near-found"))
        crowds = scope.keep(staged(crowds, "near-crowds"))
    led = kept(lambda: confirmed(more, texts, similarity))
    if crowds.isEmpty():
        return found, groups, led
    so_far = kept(lambda: connected_groups(found.unionAll(led)))
    rest = kept(lambda: pairs_of_crowds(crowds, known, so_far, similarity))
    return found, groups, kept(lambda: led.unionAll(confirmed(rest, texts, similarity)))


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(id, class, n_links) of the texts of ``docs`` that have a near duplicate: ``class`` is the smallest id of their class."""
    found, groups, more = links(docs, similarity)
    all_links = found.unionAll(more)
    ends = all_links.select("id").unionAll(all_links.select(F.col("leader").alias("id")))
    n = ends.groupBy("id").agg(F.count("*").alias("n_links"))
    named = n.join(groups, "id", "left").select("id", "n_links", F.coalesce("group_id", "id").alias("class"))
    # Links between classes join whole classes; a class is named by its smallest id.
    of = groups.select("id", "group_id")
    sides = more.join(of, "id", "left").select("leader", F.coalesce("group_id", "id").alias("a"))
    sides = sides.join(of.withColumnRenamed("id", "leader"), "leader", "left").select("a", F.coalesce("group_id", "leader").alias("b"))
    edges = sides.select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("leader"))
    joined = connected_groups(edges).withColumnsRenamed({"id": "class", "group_id": "whole"})
    return named.join(joined, "class", "left").select("id", F.coalesce("whole", "class").alias("class"), "n_links")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, id, class, class_id, class_size, n_links) for every row of ``docs`` (doc_id, text).

    ``class_id`` is the smallest doc_id of a class, ``class`` its smallest text
    id, ``class_size`` its number of rows, ``n_links`` the confirmed links of the
    row's text to other texts. Equal texts are of one class; null and empty texts
    are equal. Texts without words and different from one another have no near
    duplicates. Null ids are null class ids only where a whole class has none;
    repeated rows are rows like any other. Extra columns are left out; an empty
    table gives an empty one. Ids of texts are 64-bit hashes.
    """
    rows = docs.select("doc_id", text_id(F.col("text")).alias("id"))
    # What leads to the classes goes once they are written.
    with cleared(docs.sparkSession) as scope:
        named = classes(docs, similarity)
        texts = rows.groupBy("id").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_rows"))
        labelled = texts.join(named, "id", "left").select(
            "id", "least", "n_rows", F.coalesce("class", "id").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links")
        )
        labelled = scope.keep(staged(labelled, "near-classes"))
    # n_rows counts the texts of a class here: the join cuts classes that hold many into slices.
    sizes = labelled.groupBy("class").agg(
        F.min("least").alias("class_id"), F.sum("n_rows").alias("class_size"), F.count("*").alias("n_rows")
    )
    met = attach_group(labelled.drop("least", "n_rows"), sizes, ["class"], "inner")
    per_text = met.select("id", "class", "class_id", "class_size", "n_links")
    return rows.join(per_text, "id").select("doc_id", "id", "class", "class_id", "class_size", "n_links")
