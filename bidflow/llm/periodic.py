"""Runs: stretches of words that repeat with a period, found by seeds on diagonals.

A run of period q is words that equal those q places on, over a guaranteed
number of places. At each level the k-grams of that many words are indexed, and
occurrences of one k-gram in one document, at a distance the level is for, are
seeds of a diagonal (a lag). Where a k-gram repeats itself at a short distance,
its occurrences form chains; of two chains only pairs with an end of one are
taken, which meets every lag and keeps the seeds linear in the words. A seed is
extended unless the stretch last found on its lag covers it already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidflow.llm.common import BASE, bounded_batches, extended, flat, grouped, mixed, pieces, unused, word_bounds, word_hashes

MIN_LENGTH = 12
# Pairs of occurrences are made for so many of them at a time.
BLOCK = 1 << 18
ADDED = {
    "n_words": "bigint",
    "runs": "array<struct<start:bigint,length:bigint,period:bigint>>",
    "collapsed": "string",
}


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of neighbouring grams made one."""
    with np.errstate(over="ignore"):
        return mixed(left * np.uint64(BASE) + mixed(right))


def named(words: np.ndarray, k: int) -> np.ndarray:
    """A name for the ``k`` words from each place on; short at the end by k - 1."""
    if k == 1:
        return words
    half = k // 2
    left, right = named(words, half), named(words, k - half)
    n = max(0, len(words) - k + 1)
    return joined(left[:n], right[half : half + n])


def repeated(names: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose name occurs again, by name and place, with a number for each name. ``at`` ascends."""
    order = np.argsort(names, kind="stable")
    ranked = names[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    group = np.cumsum(new) - 1
    again = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, dtype=bool)
    return at[order][again], group[again]


def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, member) for every member of the range first..last of each row."""
    sizes = np.maximum(last - first, 0)
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)


def near_pairs(at: np.ndarray, group: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, lag) of equal grams at all lags up to ``most``, a small number."""
    for step in range(1, min(most, len(at) - 1) + 1):
        lag = at[step:] - at[:-step]
        good = (group[step:] == group[:-step]) & (lag <= most)
        if not good.any():
            return
        yield at[:-step][good], lag[good]


def far_pairs(at: np.ndarray, group: np.ndarray, k: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, lag) of equal k-grams at lags 2k .. 4k - 1, one of the two being the end of a chain."""
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = (group[1:] != group[:-1]) | (at[1:] - at[:-1] > k // 2)
    chain = np.cumsum(fresh)
    last = np.ones(len(at), dtype=bool)
    last[:-1] = fresh[1:]
    ends = np.flatnonzero(fresh | last)
    step = np.int64(size + 1)
    keys = group * step + at
    for left, right in ((np.arange(len(at)), ends), (ends, np.arange(len(at)))):
        for start in range(0, len(left), BLOCK):
            mine = left[start : start + BLOCK]
            base, place = group[mine] * step, at[mine]
            low = np.searchsorted(keys[right], base + np.minimum(place + 2 * k, step))
            high = np.searchsorted(keys[right], base + np.minimum(place + 4 * k, step))
            row, other = spread(low, high)
            a, b = mine[row], right[other]
            good = chain[a] != chain[b]
            yield at[a[good]], at[b[good]] - at[a[good]]


def heads(found: Iterator[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """lag * (size + 1) + place of the seeds, ascending; of seeds on a lag one place apart only the first."""
    step = np.int64(size + 1)
    parts = []
    for place, lag in found:
        keys = np.unique(lag * step + place)
        parts.append(keys)
    keys = np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.int64)
    if not len(keys):
        return keys
    return keys[np.concatenate([[True], np.diff(keys) > 1])]


def reach(words: np.ndarray, left: int, right: int, most: int, step: int) -> int:
    """How many words, up to ``most``, are equal from ``left`` and ``right`` on, in steps of 1 or -1."""
    done, size = 0, 32
    while done < most:
        n = min(size, most - done)
        if step > 0:
            differs = words[left + done : left + done + n] != words[right + done : right + done + n]
        else:
            differs = (words[left - done - n : left - done] != words[right - done - n : right - done])[::-1]
        if differs.any():
            return done + int(differs.argmax())
        done, size = done + n, min(size * 2, 1 << 16)
    return done


def runs_of(words: np.ndarray, sizes: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of the texts that lie one after the other, by start, then period.

    ``sizes`` are words per text; starts count over all of them. A run is a
    longest stretch with its smallest period and at least two periods and
    ``min_length`` words.
    """
    n = len(words)
    doc = grouped(sizes)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    k = min_length // 2
    found: list[tuple[int, int, int]] = []

    def extend(keys: np.ndarray) -> None:
        lag, covered = 0, 0
        for key in keys.tolist():
            this, place = divmod(key, n + 1)
            if this != lag:
                lag, covered = this, 0
            if place < covered:
                continue
            begin, end = offsets[doc[place]], offsets[doc[place] + 1]
            right = reach(words, place, place + lag, end - place - lag, 1)
            left = reach(words, place, place + lag, place - begin, -1)
            covered = place + right
            length = left + right + lag
            if length >= max(min_length, 2 * lag):
                found.append((place - left, length, lag))

    if n >= min_length:
        with np.errstate(over="ignore"):
            own = joined(words, (doc + 1).astype(np.uint64))
        names = named(own, k)
        at = np.arange(len(names))
        at = at[doc[at] == doc[at + k - 1]]
        at, group = repeated(names[at], at)
        extend(heads(near_pairs(at, group, 2 * k - 1), n))
        longest = int(sizes.max(initial=0))
        while len(at) and 4 * k <= longest:
            extend(heads(far_pairs(at, group, k, n), n))
            # A gram of twice the words occurs again only where both its halves do.
            here = np.zeros(len(names) + k, dtype=bool)
            here[at] = True
            at = np.sort(at)
            at = at[here[at + k]]
            at = at[doc[at] == doc[at + 2 * k - 1]]
            twice = np.zeros(len(names), dtype=np.uint64)
            twice[at] = joined(names[at], names[at + k])
            names, k = twice, 2 * k
            at, group = repeated(names[at], at)
    if not found:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
    start, length, period = np.array(found, dtype=np.int64).T
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    # Of lags that are multiples of a period the same stretch has the smallest alone.
    first = np.ones(len(start), dtype=bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def without_repeats(
    data: np.ndarray, offsets: np.ndarray, dropped: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts' words that are not ``dropped``, one space between them."""
    starts, ends, sizes = word_bounds(data, offsets)
    kept = np.flatnonzero(~dropped)
    doc = grouped(sizes)[kept]
    edges = np.zeros(len(data) + 1, dtype=np.int8)
    edges[starts[kept]] += 1
    edges[ends[kept]] -= 1
    mask = np.cumsum(edges[:-1], dtype=np.int8).astype(bool)
    # After a kept word that is not the text's last one, the byte of white space becomes the space.
    follows = kept[:-1][doc[1:] == doc[:-1]]
    out = data.copy()
    out[ends[follows]] = 32
    mask[ends[follows]] = True
    counts = np.concatenate([[0], np.cumsum(mask)])
    return out[mask], counts[offsets]


def with_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """``docs`` with n_words, runs (by start, then period) and collapsed: the text without the repeats of its runs.

    Words are runs of anything but ASCII white space, told apart by 64-bit
    hashes. Null and empty texts have no words, no runs and an empty collapsed
    text. Every row is a text of its own, whatever its id; extra columns pass
    through, those named like the new ones are replaced. An empty table gives
    an empty one. Memory follows the longest text.
    """
    if min_length < 2 or min_length % 2:
        raise ValueError("min_length must be even")
    rest = docs.drop(*ADDED)
    bounded_batches(docs.sparkSession)
    name = unused(rest, "text_")
    rows = rest.withColumn(name, F.col("text"))
    schema = extended(rest.schema, **ADDED)
    run_type = pa.struct([(f, pa.int64()) for f in ("start", "length", "period")])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, name):
            data, offsets = flat(batch.column(batch.num_columns - 1))
            words, sizes, _ = word_hashes(data, offsets, lower=False)
            start, length, period = runs_of(words, sizes, min_length)
            ends = np.cumsum(sizes)
            row = np.searchsorted(ends, start, "right")
            edges = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(edges, start + period, 1)
            np.add.at(edges, start + length, -1)
            text, cuts = without_repeats(data, offsets, np.cumsum(edges[:-1]) > 0)
            values = [pa.array(v) for v in (start - (ends - sizes)[row], length, period)]
            runs = pa.ListArray.from_arrays(
                np.searchsorted(row, np.arange(len(sizes) + 1)).astype(np.int32),
                pa.StructArray.from_arrays(values, fields=list(run_type)),
            )
            collapsed = pa.Array.from_buffers(
                pa.string(), len(sizes), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(text))]
            )
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes.astype(np.int64)), runs, collapsed], names=schema.names)

    return rows.mapInArrow(measured, schema)
