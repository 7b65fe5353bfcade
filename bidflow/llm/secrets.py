"""Secrets: known shapes, and strings that a battery of tests finds random.

A long string's encoding is the smallest alphabet that has all its characters.
Uniformity (chi-squared), runs above and below the alphabet's middle, and the
correlation of neighbours each give a p-value under "random"; Fisher's method
makes them one. Random strings spread evenly over these values and ordinary ones
pile up near 0, so for each encoding and length the share of ordinary strings
above a limit is known from the counts of the whole corpus, and the limit is
the smallest that keeps this false-discovery share small. Strings too short for
the tests to tell ordinary letters in their alphabet are never called random.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from bidflow.llm.common import bounded_batches, extended, flat, pieces, unused
from bidflow.shared import staged

# The known shapes, in their order, and the least length of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "random")

ADDED = {
    "shapes": "array<struct<start:int,kind:int,end:int>>",
    "strings": "array<struct<start:int,end:int,stratum:int,score:double>>",
}

MIN_CHARS = 20
STRING = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_CHARS)
IN_STRING = np.zeros(256, dtype=bool)
IN_STRING[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = True

DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
# Alphabets in the order of their values, the smallest first.
ENCODINGS = {
    "decimal": DIGITS,
    "hex": DIGITS + LOWER[:6],
    "HEX": DIGITS + UPPER[:6],
    "lower": LOWER,
    "upper": UPPER,
    "base32": UPPER + "234567",
    "lower36": DIGITS + LOWER,
    "upper36": DIGITS + UPPER,
    "letters": UPPER + LOWER,
    "alnum": DIGITS + UPPER + LOWER,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
}
VALUES = {name: {c: i for i, c in enumerate(letters)} for name, letters in ENCODINGS.items()}
SETS = {name: frozenset(letters) for name, letters in ENCODINGS.items()}

# Sum of squared shares of the characters of ordinary strings: letters, and, in hexadecimal alphabets, mostly digits.
ORDINARY, ORDINARY_HEX = 0.065, 0.1
DEVIATIONS = 4.0
GRID = 100
TEST_LEVEL = 0.01
FALSE_SHARE = 0.05
BINS = 128


def upper_chi2(x: float, df: int) -> float:
    """Upper tail of chi-squared, by the cube root of Wilson and Hilferty."""
    spread = 2 / (9 * df)
    return 0.5 * math.erfc(((max(x, 0.0) / df) ** (1 / 3) - (1 - spread)) / math.sqrt(2 * spread))


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def encoding_of(text: str) -> str | None:
    """The smallest alphabet with all characters of a string without padding; none for mixtures of base64's two."""
    letters = set(text)
    return next((name for name, has in SETS.items() if letters <= has), None)


def least_length(encoding: str) -> int:
    """From how many characters uniformity tells ordinary strings of this alphabet, by ``DEVIATIONS`` deviations.

    Digits alone are as even as random ones: no length is enough.
    """
    size = len(ENCODINGS[encoding])
    shift = size * (ORDINARY_HEX if size == 16 else ORDINARY) - 1
    if shift <= 0:
        return 1 << 62
    return max(MIN_CHARS, math.ceil(DEVIATIONS * math.sqrt(2 * (size - 1)) / shift))


def randomness(text: str, encoding: str) -> float:
    """Fisher's p-value of the three tests under "characters are random"."""
    table = VALUES[encoding]
    v = np.array([table[c] for c in text], dtype=np.float64)
    n, size = len(v), len(table)
    counts = np.bincount(v.astype(np.int64), minlength=size)
    uniform = upper_chi2(size / n * float((counts * counts).sum()) - n, size - 1)
    high = v >= size / 2
    n1 = int(high.sum())
    n2 = n - n1
    both = 2.0 * n1 * n2
    if both <= n:
        runs = 0.0
    else:
        count = 1 + int((high[1:] != high[:-1]).sum())
        runs = two_sided((count - both / n - 1) / math.sqrt(both * (both - n) / (n * n * (n - 1))))
    d = v - v.mean()
    energy = float((d * d).sum())
    serial = two_sided((float((d[1:] * d[:-1]).sum()) / energy + 1 / n) * math.sqrt(n)) if energy else 0.0
    half = -sum(math.log(max(p, 1e-300)) for p in (uniform, runs, serial))
    return math.exp(-half) * (1 + half + half * half / 2)


def stratum(encoding: str, length: int) -> int:
    """Encoding and length (quarters of its binary logarithm) as one number."""
    return list(ENCODINGS).index(encoding) * BINS + min(BINS - 1, int(4 * math.log2(length)))


def in_text(text: str, assigned: bool, strings: bool) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, float]]]:
    """(start, kind, end) of known shapes, and (start, end, stratum, p-value) of long strings."""
    shapes, found = [], []
    if assigned:
        shapes += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if strings:
        for m in STRING.finditer(text):
            # The other two shapes lie inside one long string each.
            for kind, shape in ((1, ACCESS), (2, HEX)):
                least = LEAST[KINDS[kind]]
                for part in shape.finditer(m.group()):
                    if part.end() - part.start() >= least:
                        shapes.append((m.start() + part.start(), kind, m.start() + part.end()))
            bare = m.group().rstrip("=")
            encoding = encoding_of(bare)
            if encoding and len(bare) >= least_length(encoding):
                found.append((m.start(), m.end(), stratum(encoding, len(bare)), randomness(bare, encoding)))
    return sorted(shapes), found


def hints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text, whether it has a mark of assignment, and a string of ``MIN_CHARS`` characters."""
    marks = np.flatnonzero((data == 58) | (data == 61))
    edges = np.diff(IN_STRING[data].astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    # Strings over the border of two texts count as long if their whole is; that only costs a look.
    long = np.flatnonzero(ends - starts >= MIN_CHARS)
    n = len(offsets) - 1
    marked, strings = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 2, dtype=np.int64)
    np.add.at(marked, np.searchsorted(offsets, marks, "right") - 1, 1)
    np.add.at(strings, np.searchsorted(offsets, starts[long], "right") - 1, 1)
    np.add.at(strings, np.searchsorted(offsets, ends[long] - 1, "right"), -1)
    return marked[:n] > 0, np.cumsum(strings)[:n] > 0


def scanned(docs: DataFrame) -> DataFrame:
    """``docs`` with known shapes and long strings (with their p-values) of the whole ``text``; places are code points."""
    rest = docs.drop(*ADDED)
    bounded_batches(docs.sparkSession)
    name = unused(rest, "text_")
    schema = extended(rest.schema, **ADDED)
    kinds = [f.type for f in to_arrow_schema(schema)][-2:]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, name):
            texts = batch.column(batch.num_columns - 1)
            looks = zip(*hints(*flat(texts)), strict=True)
            found = [in_text(texts[i].as_py(), a, s) if a or s else ([], []) for i, (a, s) in enumerate(looks)]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            for part, kind in enumerate(kinds):
                fields = [kind.value_type.field(i).name for i in range(kind.value_type.num_fields)]
                rows = [[dict(zip(fields, value, strict=True)) for value in one[part]] for one in found]
                columns.append(pa.array(rows, kind))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rest.withColumn(name, F.col("text")).mapInArrow(read, schema)


def limits(scans: DataFrame, false_share: float = FALSE_SHARE) -> dict[int, float]:
    """By stratum, the least p-value with at most ``false_share`` ordinary strings above it, from all rows.

    Twice the strings above one half are the random ones; copies of a string
    count once. The driver sees at most one count for each stratum and step.
    """
    different = scans.select(F.explode("strings").alias("s")).select("s.stratum", "s.score").distinct()
    step = F.least(F.floor(F.col("score") * GRID), F.lit(GRID - 1)).cast("int")
    counts: dict[int, list[int]] = defaultdict(lambda: [0] * GRID)
    for row in different.groupBy("stratum", step.alias("step")).agg(F.count("*").alias("n")).collect():
        counts[row["stratum"]][row["step"]] = row["n"]
    found = {}
    for name, n in counts.items():
        random = 2 * sum(n[GRID // 2 :])
        for at in range(max(1, round(TEST_LEVEL * GRID)), GRID):
            above = sum(n[at:])
            if above and random * (1 - at / GRID) >= (1 - false_share) * above:
                found[name] = at / GRID
                break
    return found


def spans(most: dict[int, float]) -> Column:
    """All spans (start, kind, end) of scanned rows, in order: known shapes, and random strings that meet none of them."""
    pairs = ", ".join(f"{k}, {v!r}D" for k, v in sorted(most.items()))
    table = F.expr(f"map({pairs})" if pairs else "cast(map() as map<int,double>)")
    shapes = F.col("shapes")

    def random(s: Column) -> Column:
        meets = F.exists(shapes, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return F.coalesce(s["score"] >= F.element_at(table, s["stratum"]), F.lit(False)) & ~meets

    added = F.transform(
        F.filter("strings", random),
        lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), s["end"].alias("end")),
    )
    return F.array_sort(F.concat(shapes, added))


def listed(places: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(places, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def with_secrets(docs: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """``docs`` with shapes, strings and spans: (start, kind, end), kind a place in ``KINDS``, end exclusive.

    Null and empty texts have none. Every row is a text of its own, whatever its
    id; extra columns pass through, those named like the new ones are replaced.
    An empty table gives an empty one. Memory follows the longest text. The
    table is read once and written to the shared folder, since limits come from
    all rows: leave out columns that are not needed after (see ``without_text``).
    """
    return _decided(scanned(docs.drop("spans")), false_share)


def without_text(docs: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """As ``with_secrets``, but without the column ``text``."""
    return _decided(scanned(docs.drop("spans")).drop("text"), false_share)


def _decided(scans: DataFrame, false_share: float) -> DataFrame:
    scans = staged(scans, "scans")
    return scans.withColumn("spans", spans(limits(scans, false_share)))
