"""The corpus operators on small tables: brute force, and rows that are easily mishandled."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bidflow.llm import (
    common,
    decontamination,
    fingerprints,
    language,
    line_dedup,
    lm,
    mixing,
    near_dedup,
    quality,
    token_counts,
    toxicity,
)

SMALL = "/root/testdata/sf0.001"
LONG = "the quick word " * 9000 + "x" * 70_000
ODD = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \n\t\n ", None, None),
    (None, "one line\nTwo  words here\r\n", "en", "b"),
    (4, LONG, "en", "b"),
    (5, "same row", "de", "b"),
    (5, "same row", "de", "b"),
    (5, "same id, other text", "de", "c"),
    (6, "same row", "fr", None),
    (7, "ÄÖ́ <|endoftext|>x \U0001f600 don't 12345", "fr", "c"),
    (8, "\x0b\x0c\x1c word", "es", "c"),
]
COLUMNS = "doc_id bigint, text string, lang string, source string"
# Columns a user's table may have, with names the operators use themselves.
CLASHES = ["_text", "text_", "hash", "text_hash", "id", "block", "n", "x", "dropped", "row", "size", "shard", "key", "label", "_id"]


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(ODD, COLUMNS)
    return docs.withColumns({c: F.lit("mine") for c in CLASHES})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def real(spark):
    return common.table(spark, SMALL, "documents")


def words(text):
    return (text or "").encode().lower().split()


def untouched(before, after):
    rows = after.select(*CLASHES).distinct().collect()
    assert rows == [tuple(["mine"] * len(CLASHES))] and before.count() == after.count()


# --- hashes ---


def test_word_hashes_tell_words_apart(monkeypatch):
    monkeypatch.setattr(common, "SLICE_BYTES", 16)
    texts = ["a b  a", None, "", "ab AB\tab a-very-long-word-over-the-slice b", "\n"]
    h, counts, prefixes = common.word_hashes(*common.flat(pa.array(texts)), (2,))
    flat = [w for t in texts for w in words(t)]
    assert counts.tolist() == [len(words(t)) for t in texts]
    assert len(set(h.tolist())) == len(set(flat))
    assert {w: x for w, x in zip(flat, h.tolist())} == dict(zip(flat, h.tolist()))
    for i, a in enumerate(flat):
        for j, b in enumerate(flat):
            assert (h[i] == h[j]) == (a == b)
            if len(a) > 2 and len(b) > 2:
                assert (prefixes[0][i] == prefixes[0][j]) == (a[:2] == b[:2])


def test_pieces_keep_all_rows():
    batch = pa.record_batch({"text": pa.array(["x" * n for n in (5, 0, 50, 1, 1, 1, 30)])}).slice(1)
    cut = list(common.pieces(iter([batch]), "text", 10))
    assert [t for b in cut for t in b.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert len(cut) > 2


# --- 1: language model ---


def brute_scores(rows):
    c, pairs, states, kinds = Counter(), Counter(), Counter(), Counter()
    start = object()
    for _, text, held in rows:
        if not held:
            tokens = [*words(text), None]
            c.update(tokens)
            for h, w in zip([start, *tokens], tokens):
                kinds[h] += (h, w) not in pairs
                pairs[h, w] += 1
                states[h] += 1
    n, v, out = sum(c.values()), len(c), Counter()
    for doc_id, text, held in rows:
        tokens = [*words(text), None]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens)
        score = 0.0
        for h, w in zip([start, *tokens], tokens):
            p = (c[w] + 1) / (n + v + 1)
            score += math.log10((pairs[h, w] + kinds[h] * p) / (states[h] + kinds[h]) if states[h] else p)
        out[doc_id, held, len(tokens), sum(c[w] > 0 for w in tokens), n, round(base, 6), round(score, 6)] += 1
    return out


def scored_rows(found):
    return Counter(
        (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))
        for r in found.collect()
    )


@pytest.mark.parametrize("block_bytes, shard_tokens", [(1 << 20, 1 << 20), (2000, 3000)])
def test_lm_scores_equal_brute_force(real, odd, block_bytes, shard_tokens):
    docs = real.select("doc_id", "text").unionAll(odd.select("doc_id", "text"))
    docs = docs.withColumn("held_out", common.remainder(F.col("doc_id"), 7) == 2)
    rows = [(r.doc_id, r.text, r.held_out) for r in docs.collect()]
    assert all(h == (zlib.crc32(str("" if i is None else i).encode()) % 7 == 2) for i, _, h in rows)
    assert scored_rows(lm.scores(docs, block_bytes, shard_tokens)) == brute_scores(rows)


def test_lm_with_a_word_that_is_a_third_of_all(spark):
    rows = [(i, " ".join(["hot", f"w{i % 50}", f"v{i}"] * 4), i % 9 == 0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, held_out boolean")
    assert scored_rows(lm.scores(docs, 3000, 500)) == brute_scores(rows)


def test_lm_without_training_texts(spark, none):
    empty = none.withColumn("held_out", F.lit(True))
    assert lm.scores(empty).count() == 0
    one = spark.createDataFrame([(1, "a b", True)], "doc_id bigint, text string, held_out boolean")
    r = lm.scores(one).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


# --- 2: fingerprints ---


def brute_phrases(data):
    seen, phrase = set(), b""
    for i in range(len(data)):
        phrase += data[i : i + 1]
        if phrase not in seen:
            seen.add(phrase)
            phrase = b""
    return seen


def test_parse_finds_the_phrases():
    data = LONG[:4000].encode() + b"abababababab"
    parse = fingerprints.Parse().feed(data[:1000]).feed(data[1000:])
    assert len(parse.hashes) - 1 == len(brute_phrases(data)) == len(set(parse.hashes[1:]))
    small, other = "some text with few phrases", "some text with other phrases"
    a, b = (fingerprints.Parse().feed(t.encode()).signature() for t in (small, other))
    pa_, pb = brute_phrases(small.encode()), brute_phrases(other.encode())
    assert fingerprints.likeness(a, b) == pytest.approx(len(pa_ & pb) / len(pa_ | pb))


def test_large_dictionaries_are_emptied(monkeypatch):
    monkeypatch.setattr(fingerprints, "PHRASES", 50)
    parse = fingerprints.Parse().feed(LONG[:2000].encode())
    assert len(parse.hashes) <= 101 and len(parse.signature()) > 50


@pytest.mark.parametrize("partitions", [1, 5])
def test_fingerprints_follow_the_order(odd, partitions):
    got = fingerprints.compared(odd, partitions).collect()
    rows = sorted(
        ((i is None, i or 0, t or "") for i, t, _, _ in ODD), key=lambda r: r[:2]
    )
    assert len(got) == len(rows)
    fives = [r for r in got if r.doc_id == 5]
    by_text = defaultdict(set)
    for r in got:
        text = next(t for null, i, t in rows if (None if null else i) == r.doc_id and r.n_chars == len(t))
        by_text[text].add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values()) and len(fives) == 3
    order = {None if null else i: t for null, i, t in rows if i != 5}
    for doc_id, following in ((4, None), (6, 7), (7, 8), (8, None), (None, 1), (2, 3)):
        if doc_id == 4:
            continue
        text, after = order[doc_id], order[following]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        found = next(r for r in got if r.doc_id == doc_id)
        assert found.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), doc_id
        sides = [fingerprints.Parse().feed(t.encode()).signature() for t in (text, edited, after)]
        assert found.fingerprint == fingerprints.written(sides[0]) and found.edited_fingerprint == fingerprints.written(sides[1])
        assert found.near_edited == fingerprints.likeness(sides[0], sides[1])
        assert found.near_next == fingerprints.likeness(sides[0], sides[2])
        assert fingerprints.read(found.fingerprint).tolist() == sides[0].tolist()


def test_fingerprints_of_few_rows(spark, none):
    assert fingerprints.compared(none).count() == 0
    r = fingerprints.compared(spark.createDataFrame([(1, "abcd")], "doc_id bigint, text string")).first()
    assert r.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and r.near_next == 1.0


# --- 3: token counts ---


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts_are_the_librarys(real, odd, none, name):
    import public_tokenizers

    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        count = lambda t: len(model.encode(t, add_special_tokens=False).ids)
    else:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    docs = real.select("doc_id", "text").where("doc_id % 2 = 0")
    rows = docs.withColumn("copy", F.col("text")).unionAll(odd.select("doc_id", "text", F.col("text")))
    for r in token_counts.token_counts(rows, path, limit=100).collect():
        text = r.copy or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), count(text), count(text) > 100), text[:60]
    assert token_counts.token_counts(none, path).count() == 0
    untouched(odd, token_counts.token_counts(odd, path))


# --- 4: quality ---


def test_statistics_and_discriminant():
    texts = ["Hello there\nA 1!", None, "", "a a b", "ÄÄ"]
    x = quality.statistics(pa.array(texts))
    assert x.shape == (5, quality.N) and not x[1:3].any()
    assert x[0][0] == pytest.approx(math.log(5)) and x[3][7] == pytest.approx(2 / 3)
    assert x[0][2] == pytest.approx(math.sqrt(2 / 13)) and x[4][6] == pytest.approx(1.0)
    rng = np.random.default_rng(1)
    moments, data = {}, {}
    for k in (0, 1):
        data[k] = rng.normal(k * 2.0, 1 + k, (500, quality.N))
        moments[k] = (500.0, data[k].sum(axis=0), data[k].T @ data[k])
    model = quality.model_of(moments)
    for k, rows in data.items():
        cov = np.linalg.inv(model.factors[k]) @ np.linalg.inv(model.factors[k]).T
        pooled = np.diag((np.cov(data[0].T, bias=True) + np.cov(data[1].T, bias=True)).diagonal() / 2 + quality.FLOOR)
        wanted = 0.9 * np.cov(rows.T, bias=True) + 0.1 * pooled + quality.FLOOR * np.eye(quality.N)
        assert np.allclose(cov, wanted)
        assert ((model.scores(rows) > 0.5) == k).mean() > 0.95


def test_quality_of_odd_rows(spark, odd, none):
    rows = quality.with_statistics(odd.drop("x"))
    model = quality.fit(rows.withColumn("label", F.when(F.col("doc_id") < 5, 1).otherwise(0)))
    got = rows.withColumn("score", quality.score(F.col("x"), model)).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality.fit(quality.with_statistics(none).withColumn("label", F.lit(1))) == 0.5
    assert quality.fit(rows.withColumn("label", F.lit(1))) == 1.0
    assert rows.withColumn("score", quality.score(F.col("x"), 0.5)).where("score = 0.5").count() == len(ODD)


# --- 5: mixing ---


def brute_apportion(weights, seats, caps):
    out = [0] * len(weights)
    for _ in range(min(seats, sum(c for w, c in zip(weights, caps) if w > 0))):
        free = [i for i, w in enumerate(weights) if w > 0 and out[i] < caps[i]]
        best = max(free, key=lambda i: (weights[i] / (2 * out[i] + 1), -i))
        out[best] += 1
    return out


def test_apportion_gives_seats_by_highest_quotients():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(1, 7))
        weights = rng.integers(0, 40, n).astype(float).tolist()
        caps, seats = rng.integers(0, 30, n).tolist(), int(rng.integers(0, 80))
        assert mixing.apportion(weights, seats, caps) == brute_apportion(weights, seats, caps)
    assert mixing.apportion([], 0, []) == []


def test_targets_share_the_excess():
    got = mixing.targets([100, 10, 1000, 0], [3, 1, 2, 3])
    assert got[1] == 20 and got[0] == 200 and got[3] == 0 and sum(got) == pytest.approx(1.5 * 1110)
    assert mixing.targets([], []) == []


def brute_mix(rows, block_words, shard_words):
    """(doc_id, size, source, taken) by the rules, block by block."""
    drawn = lambda *p: hashlib.md5("|".join([str(mixing.SEED), *map(str, p)]).encode()).hexdigest()
    sized = [(i, len(words(t)), s) for i, t, s in rows]
    texts = {(i, len(words(t))): t for i, t, _ in rows}
    sources = sorted({s for _, _, s in sized}, key=lambda s: (s is None, s or ""))
    size_of = {s: sum(n for _, n, t in sized if t == s) for s in sources}
    goal = mixing.targets([size_of[s] for s in sources], [mixing.WEIGHTS[k % 3] for k in range(len(sources))])
    shards = defaultdict(list)
    for i, n, s in sized:
        k = sources.index(s)
        if n:
            draw = drawn(hashlib.md5(texts[i, n].encode()).hexdigest() if i is None else i)
            shards[k, int(draw[:8], 16) % max(1, -(-size_of[s] // shard_words))].append((draw, i, n))
    length = {k: max(b for b in (1, 2, 4, 8, 16, 32, 64) if b <= block_words and (b == 1 or 64 * b <= size_of[s])) for k, s in enumerate(sources)}
    blocks = {key: -(-sum(n for _, _, n in docs) // length[key[0]]) for key, docs in shards.items()}
    order = sorted({k for k, _ in shards})
    own = {k: sorted(x for x in shards if x[0] == k) for k in order}
    seats = {}
    for b in set(length.values()):
        alike = [k for k in order if length[k] == b]
        caps = [2 * sum(blocks[x] for x in own[k]) for k in alike]
        seats |= zip(alike, brute_apportion([goal[k] for k in alike], round(sum(goal[k] for k in alike) / b), caps))
    out = Counter((i, 0, s, 0) for i, n, s in sized if not n)
    for k, mine in seats.items():
        quota = brute_apportion([sum(n for _, _, n in shards[x]) for x in own[k]], mine, [2 * blocks[x] for x in own[k]])
        for x, q in zip(own[k], quota):
            ranked = sorted(range(blocks[x]), key=lambda b: drawn(k, x[1], b))
            times = {b: q // blocks[x] + (r < q % blocks[x]) for r, b in enumerate(ranked)}
            at = 0
            for _, i, n in sorted(shards[x]):
                out[i, n, sources[k], sum(times[w // length[k]] for w in range(at, at + n))] += 1
                at += n
    return out


@pytest.mark.parametrize("block_words, shard_words", [(64, 1_000_000), (16, 500)])
def test_mix_equals_brute_force(real, odd, block_words, shard_words):
    docs = real.select("doc_id", "text", "source").unionAll(odd.select("doc_id", "text", "source").where("doc_id <> 5"))
    rows = [tuple(r) for r in docs.collect()]
    got = mixing.mixed(docs, block_words=block_words, shard_words=shard_words)
    found = got.collect()
    assert Counter((r.doc_id, r.size, r.source, r.taken) for r in found) == brute_mix(rows, block_words, shard_words)
    assert all(0 <= r.taken <= 2 * r.size for r in found)
    again = mixing.mixed(docs.repartition(7), block_words=block_words, shard_words=shard_words).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))


@pytest.mark.parametrize("sizes", [[20] * 30, [15, 1000], [5, 40, 100, 300, 7, 64, 65], [1, 1, 1], [3000, 9000, 4]])
def test_small_sources_come_near_their_targets(spark, sizes):
    rows = []
    for k, size in enumerate(sizes):
        left = size
        while left:
            n = min(left, 1 + (7 * len(rows)) % 30)
            rows.append((len(rows) if len(rows) % 5 else None, f"s{k:02d}", " ".join(["word", f"w{len(rows)}"] * n).split()[:n]))
            left -= n
    docs = spark.createDataFrame([(i, s, " ".join(w)) for i, s, w in rows], "doc_id bigint, source string, text string")
    found = mixing.mixed(docs).collect()
    assert all(0 <= r.taken <= 2 * r.size for r in found)
    for s in {r.source for r in found}:
        mine = [r for r in found if r.source == s]
        taken, target, size = sum(r.taken for r in mine), mine[0].target, mine[0].source_size
        assert abs(taken - target) <= max(1.5, size / 25), (s, taken, target)


def test_mix_of_odd_rows(odd, none):
    got = mixing.mixed(odd)
    assert got.count() == len(ODD) and got.where("taken > 2 * size or target is null").count() == 0
    assert mixing.mixed(none).count() == 0


# --- 6: decontamination ---


def brute_edits(passage, text):
    """Least edits of ``passage`` anywhere in ``text``."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(passage, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_edited_passages_are_found_within_the_budget():
    rng = np.random.default_rng(5)
    letters = np.array(list("etaoin shrdlu"))
    items = [(i, "".join(rng.choice(letters, 50 + 20 * i))) for i in range(6)]
    index = decontamination.index_of(items)
    plain = lambda t: decontamination.plain(*common.flat(pa.array([t])))[0].tobytes()
    for trial in range(120):
        item_id, text = items[trial % 6]
        edited = list(text)
        for _ in range(trial % 11):
            at, kind = int(rng.integers(len(edited))), trial % 3
            if kind == 0:
                edited[at] = "q"
            elif kind == 1:
                edited.insert(at, "z")
            else:
                del edited[at]
        around = ["".join(rng.choice(letters, 200)) for _ in range(2)]
        doc = around[0] + "".join(edited) + around[1]
        got = {x["item_id"]: x["edits"] for x in decontamination.found_in(pa.array([doc]), index)[0]}
        least = {}
        for p, budget, i in zip(index.passages, index.budget.tolist(), index.items.tolist()):
            e = brute_edits(p, plain(doc))
            if e <= budget:
                least[i] = min(e, least.get(i, e))
        assert got.keys() == least.keys(), trial
        assert all(got[k] >= least[k] for k in got)


def test_excerpts_are_found_wherever_they_start():
    rng = np.random.default_rng(15)
    letters = np.array(list("etaoin shrdlu"))
    item = "".join(rng.choice(letters, 420)).replace("  ", " e").strip()
    index = decontamination.index_of([(1, item)])
    # What is around an excerpt shares no byte with the item.
    docs = [f"{'Z' * 200}{item[at : at + 120]}{'Z' * 200}" for at in range(len(item) - 119)]
    found = decontamination.found_in(pa.array(docs), index)
    assert [at for at, leaks in enumerate(found) if [x["item_id"] for x in leaks] != [1]] == []


def test_leaks_of_odd_rows_and_of_many_blocks(spark, odd, none):
    item = "A passage of the benchmark that is long enough to be told from chance"
    bench = spark.createDataFrame(
        [(1, item), (2, None), (None, item), (3, "short"), (4, ""), (5, "another passage that nobody ever repeats anywhere at all"), (6, item)],
        "item_id bigint, text string",
    )
    docs = odd.withColumn("text", F.when(F.col("doc_id") == 5, F.lit("So: a PASSAGE of \n the benchmark that is long enough to be told from chance."))
                          .otherwise(F.col("text")))
    for block_bytes in (1 << 20, 60):
        got = decontamination.with_leaks(docs, bench, block_bytes=block_bytes)
        untouched(docs, got)
        for r in got.collect():
            assert [x.item_id for x in r.leaks] == ([1, 6] if r.doc_id == 5 else [])
            assert all(x.edits == 0 and x.start == 4 for x in r.leaks)
    assert decontamination.with_leaks(none, bench).count() == 0
    assert decontamination.with_leaks(docs, bench.where("false")).where("size(leaks) > 0").count() == 0


def test_leaks_in_long_texts(monkeypatch):
    monkeypatch.setattr(decontamination, "SLICE_BYTES", 100)
    item = "A passage of the benchmark that is long enough to be told from chance"
    index = decontamination.index_of([(9, item)])
    texts = ["x " * 80 + item + " y" * 500, item, None, "", item[:40], "z" * 300]
    assert [[x["item_id"] for x in f] for f in decontamination.found_in(pa.array(texts), index)] == [[9], [9], [], [], [], []]


# --- 7: toxicity ---


def test_chain_learns_words_and_calls_documents(spark, none):
    rng = np.random.default_rng(7)
    plain = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(600):
        text = list(rng.choice(plain, 40))
        if i % 6 == 0:
            text[5:5] = [f"vile{'abcdef'[i % 5]}{i % 7}!", "Scum,"] * (1 + i % 3)
        rows.append((i, " ".join(text), int(i % 6 == 0)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    chain = toxicity.fit(docs, docs.select("doc_id", "toxic").unionAll(docs.select(F.lit(None).cast("bigint"), "toxic").limit(3)))
    got = toxicity.scored(docs.withColumnRenamed("toxic", "y"), chain).collect()
    assert all(r.toxic == (r.y == 1) for r in got)
    assert all(0 <= p <= 1 for r in got for p in (r.p_marked, r.p_repeated, r.p_toxic))
    many = [r.p_repeated for r in got if r.doc_id % 6 == 0 and r.doc_id % 3 == 0]
    assert min(many) > max(r.p_repeated for r in got if r.y == 0)
    blank = toxicity.fit(none, none.select("doc_id", F.lit(1).alias("toxic")))
    assert toxicity.scored(none, blank).count() == 0
    assert toxicity.scored(docs, blank).where("toxic").count() == 0


def test_later_models_see_out_of_fold_predictions():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3))
    labels = np.column_stack([x[:, 0] > 0, x[:, 0] + x[:, 1] > 0])
    folds = np.arange(200) % 5
    weights = toxicity.trained_chain(x, labels, folds)
    assert [len(w) for w in weights] == [4, 5]
    first = np.zeros(200)
    base = toxicity.with_constant(x, [])
    for f in range(5):
        rest = folds != f
        first[~rest] = toxicity.sigmoid(base[~rest] @ toxicity.logistic(base[rest], labels[rest, 0].astype(float)))
    assert np.allclose(weights[1], toxicity.logistic(toxicity.with_constant(x, [first]), labels[:, 1].astype(float)))
    assert toxicity.chained(x, weights).shape == (200, 2)


def test_toxicity_of_odd_rows(odd):
    chain = toxicity.fit(odd, odd.where("doc_id in (4, 7)").select("doc_id", (F.col("doc_id") == 7).cast("int").alias("toxic")))
    untouched(odd, toxicity.scored(odd, chain))


# --- 8: lines ---


def brute_lines(rows, min_docs, keep="none"):
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)})
    split = [(i, (t or "").split("\n")) for i, t in rows]
    n = Counter(k for _, lines in split for k in {key(x) for x in lines} if k)
    return Counter(
        (i, len(lines), "\n".join(x for x in lines if n[key(x)] < min_docs or not key(x))) for i, lines in split
    )


def test_line_dedup_equals_brute_force(real, odd):
    docs = real.select("doc_id", "text").unionAll(odd.select("doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for min_docs in (2, 10):
        got = line_dedup.deduplicated(docs, min_docs)
        assert Counter((r.doc_id, r.n_lines, r.kept_text) for r in got.collect()) == brute_lines(rows, min_docs)


def test_first_occurrences_stay(spark):
    rows = [(1, "a\nB\na"), (2, " b \nc"), (3, "b\na"), (3, "b\na"), (4, None)]
    got = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string"), 2, keep="first")
    kept = sorted((r.doc_id, r.kept_text, r.n_dropped, [tuple(x) for x in r.kept]) for r in got.collect())
    assert kept == [(1, "a\nB", 1, [(0, 1)]), (2, "c", 1, [(1, 1)]), (3, "", 2, []), (3, "", 2, []), (4, "", 0, [(0, 0)])]
    with pytest.raises(ValueError, match="keep"):
        line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string"), keep="last")


def test_lines_of_odd_rows(odd, none):
    untouched(odd, line_dedup.deduplicated(odd, 2))
    assert line_dedup.deduplicated(none).count() == 0


def test_line_dedup_is_native(real):
    plan = line_dedup.deduplicated(real)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and not any(x in plan for x in ("Python", "Arrow", "Pandas"))


# --- 9: near duplicates ---


def brute_aligned(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1] / max(len(a), len(b))


def test_alignment_equals_a_whole_table():
    rng = np.random.default_rng(9)
    for trial in range(150):
        a = rng.integers(0, 30, int(rng.integers(1, 60))).astype(np.uint32)
        b = a.copy().tolist()
        for _ in range(int(rng.integers(0, 14))):
            at = int(rng.integers(0, max(len(b), 1)))
            b[at : at + int(rng.integers(0, 2))] = rng.integers(0, 30, int(rng.integers(0, 2))).tolist()
        b = np.array(b, dtype=np.uint32)
        whole = brute_aligned(a.tolist(), b.tolist()) if len(b) else 0.0
        got = near_dedup.aligned(a, b)
        assert (got >= 0.8) == (whole >= 0.8), trial
        if whole >= 0.8:
            assert got == pytest.approx(whole)
    assert near_dedup.aligned(np.zeros(0, np.uint32), np.zeros(0, np.uint32)) == 0.0


def test_sketches_depend_on_order_and_repeats():
    rng = np.random.default_rng(4)
    w = rng.integers(0, 1 << 62, 300, dtype=np.uint64)
    assert near_dedup.sketches(w).tolist() == near_dedup.sketches(w.copy()).tolist()
    assert len(set(near_dedup.kmers(np.tile(w[:5], 4)).tolist())) == 16
    moved = np.concatenate([w[150:], w[:150]])
    same = (near_dedup.sketches(w) == near_dedup.sketches(moved)).mean()
    assert 0.2 < same < 0.8
    assert not len(near_dedup.sketches(w[:0])) and len(near_dedup.sketches(w[:2])) == near_dedup.SKETCHES
    whole = near_dedup.sketches(w)
    near_dedup.SLICE, before = 32, near_dedup.SLICE
    assert near_dedup.sketches(w).tolist() == whole.tolist()
    near_dedup.SLICE = before


def test_classes_equal_all_pairs(spark):
    rng = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    shared = " ".join(rng.choice(vocabulary, 30))
    texts = []
    for group in range(12):
        base = rng.choice(vocabulary, int(rng.integers(40, 200))).tolist()
        for _ in range(int(rng.integers(1, 8))):
            copy = base[:]
            for _ in range(int(0.04 * len(copy))):
                copy[int(rng.integers(len(copy)))] = str(rng.choice(vocabulary))
            texts.append(" ".join(copy))
    # Many texts with a passage in common and nothing else, and a large group of copies.
    texts += [shared + " " + " ".join(rng.choice(vocabulary, 60)) for _ in range(60)]
    texts += [texts[0]] * 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    split = [t.split() for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or (min(len(split[i]), len(split[j])) >= 0.8 * max(len(split[i]), len(split[j]))
                                        and len(set(split[i]) & set(split[j])) > 20 and brute_aligned(split[i], split[j]) >= 0.8):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert got == {i: root(i) for i in range(len(texts))}


def test_pairs_with_a_passage_of_thousands_of_texts(spark):
    rng = np.random.default_rng(11)
    vocabulary = np.array([f"w{i}" for i in range(20000)])
    passage = rng.choice(vocabulary, 60).tolist()
    pairs, texts = [], []
    for _ in range(40):
        own = rng.choice(vocabulary, 40).tolist()
        other = own[:]
        for at in rng.choice(40, 18, replace=False):
            other[at] = str(rng.choice(vocabulary))
        pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join(passage + own), " ".join(passage + other)]
    texts += [" ".join(passage + rng.choice(vocabulary, 40).tolist()) for _ in range(2500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    least = {b: a for a, b in pairs}
    assert got == {i: least.get(i, i) for i in range(len(texts))}


def test_pairs_at_the_limit_are_found(spark):
    """Every fifth, sixth or seventh word replaced, or 15 to 20 % at random, in even and in natural word frequencies."""
    rng = np.random.default_rng(12)
    vocabulary = np.array([f"w{i}" for i in range(30000)])

    def text(n, natural):
        return vocabulary[(rng.zipf(1.3, n) - 1) % 30000 if natural else rng.integers(0, 30000, n)].tolist()

    pairs, texts = [], []
    for natural in (False, True):
        for n in (30, 200, 1000):
            for _ in range(12):
                places = [range(k - 1, n, k) for k in (5, 6, 7)]
                places += [rng.choice(n, round(n * share), replace=False) for share in (0.15, 0.2)]
                for at in places:
                    base = text(n, natural)
                    other = base[:]
                    for i in at:
                        other[i] = f"z{rng.integers(1 << 40)}"
                    pairs.append((natural, len(texts)))
                    texts += [" ".join(base), " ".join(other)]
    texts += [" ".join(text(int(rng.integers(20, 400)), True)) for _ in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert all(got[i + 1] == i for natural, i in pairs if not natural)
    assert sum(got[i + 1] == i for natural, i in pairs if natural) >= 0.95 * len(pairs) / 2
    assert all(got[i] == i for i in range(2 * len(pairs), len(texts)))


def test_alignment_in_a_moving_window_equals_whole_rows(monkeypatch):
    rng = np.random.default_rng(14)
    for trial in range(120):
        a = rng.integers(0, int(rng.choice([3, 30, 1000])), int(rng.integers(1, 200))).astype(np.uint32)
        b = a.tolist()
        for _ in range(int(rng.integers(0, 30))):
            at = int(rng.integers(0, max(len(b), 1)))
            b[at : at + int(rng.integers(0, 3))] = rng.integers(0, 30, int(rng.integers(0, 3))).tolist()
        b = np.array(b, dtype=np.uint32)
        whole = near_dedup.aligned(a, b)
        monkeypatch.setattr(near_dedup, "WHOLE_ROWS", 0)
        monkeypatch.setattr(near_dedup, "PLACES", int(rng.choice([1, 64])))
        assert near_dedup.aligned(a, b) == whole, trial
        monkeypatch.undo()


def test_alignment_of_long_texts_takes_memory_in_proportion():
    import tracemalloc

    rng = np.random.default_rng(15)
    for words in (rng.integers(0, 1 << 30, 60_000), rng.zipf(1.2, 60_000) % 50_000):
        a = words.astype(np.uint32)
        b = a.copy()
        b[rng.choice(60_000, 6_000, replace=False)] = 1 << 31
        b[0] = b[-1] = 1 << 31
        tracemalloc.start()
        share = near_dedup.aligned(a, b)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert 0.89 < share < 0.91 and peak < 30_000_000


def test_draws_of_alike_texts_agree():
    rng = np.random.default_rng(16)
    agreed = []
    for _ in range(300):
        a = rng.integers(0, 1 << 62, int(rng.integers(5, 300)), dtype=np.uint64)
        b = a.copy()
        b[rng.choice(len(a), len(a) // 5, replace=False)] = rng.integers(0, 1 << 62, dtype=np.uint64)
        x, y = (near_dedup.signature(near_dedup.drawn(w)[1]).view(np.uint64) for w in (a, b))
        both = [(int(p) >> 4 * i & 15) == (int(q) >> 4 * i & 15) for p, q in zip(x, y, strict=True) for i in range(16)]
        assert len(both) == near_dedup.DRAWS
        agreed.append(sum(both))
    assert min(agreed) >= near_dedup.AGREEING and 42 < np.mean(agreed) < 48


def test_short_texts_equal_all_pairs(spark):
    rng = np.random.default_rng(13)
    texts = []
    for n in range(5, 27):
        for _ in range(6):
            base = [f"w{i}" for i in rng.integers(0, 3000, n)]
            other = base[:]
            at = int(rng.integers(n))
            other[at : at + 1] = [[f"w{int(rng.integers(3000))}"], []][int(rng.integers(2))]
            texts += [" ".join(base), " ".join(other)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    split = [t.split() for t in texts]
    alike = [(i, j) for j in range(len(texts)) for i in range(j) if set(split[i]) & set(split[j]) and brute_aligned(split[i], split[j]) >= 0.8]
    assert len(alike) > 100
    # Bases are unlike each other: a class is a pair.
    least = {j: i for i, j in alike}
    assert len(least) == len(alike) and got == {i: least.get(i, i) for i in range(len(texts))}


def test_near_duplicates_of_odd_rows(odd, none):
    got = near_dedup.near_duplicates(odd)
    rows = got.collect()
    assert len(rows) == len(ODD)
    sizes = {(r.doc_id, r.class_id): r.class_size for r in rows}
    assert sizes[1, 1] == sizes[2, 1] == 2 and sizes[6, 5] == 3 and sizes[3, 3] == 1 and sizes[None, None] == 1
    assert near_dedup.near_duplicates(none).count() == 0


# --- 10: language ---


def test_presence_is_the_set_of_grams(monkeypatch):
    texts = pa.array(["abcab", None, "", "AB", "é" * 30 + " abc"])
    whole = language.presence(texts)
    monkeypatch.setattr(language, "SLICE_BYTES", 4)
    assert (language.presence(texts) == whole).all()

    def bins(text):
        data = text.lower().encode()
        return {(int.from_bytes(data[i : i + n], "big") + n) * 2654435761 % (1 << 32) >> 18 for n in language.GRAMS for i in range(len(data) - n + 1)}

    for row, text in zip(whole, texts.to_pylist()):
        assert set(np.flatnonzero(row).tolist()) == bins(text or "")


def test_kernel_ridge_equals_the_closed_form():
    rng = np.random.default_rng(8)
    found = rng.random((40, language.BINS)) < 0.01
    names = ["a", "b"] * 20
    model = language.trained(found, names, landmarks=40, ridge=0.5)
    k = (found.astype(float) @ found.T) / np.sqrt(np.outer(found.sum(1), found.sum(1)))
    y = np.where(np.array([[n == m for m in ("a", "b")] for n in names]), 1.0, -1.0)
    # With all rows as landmarks the map is exact: ridge regression with the kernel itself, rows weighing 1/20.
    wanted = k @ np.linalg.solve(k + 0.5 * 20 * np.eye(40), y)
    assert np.allclose(model.scores(found), wanted, atol=1e-3)


def test_languages_of_odd_rows(real, odd, none):
    model = language.fit(real.select("doc_id", "text", "lang"))
    got = language.predicted(odd, model)
    untouched(odd, got)
    for r in got.select("doc_id", "lang_pred", "score").collect():
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (r.doc_id in (1, 2, 3)), r
    assert language.fit(none) is None
    assert language.predicted(odd, None).where("lang_pred <> 'und' or score <> 0").count() == 0
    assert language.predicted(none, model).count() == 0
    digits = odd.limit(1).withColumn("text", F.lit("123 ½ ² --"))
    assert language.predicted(digits, model).first().lang_pred == "und"


def test_sample_is_bounded_when_one_row_repeats(spark):
    rows = [(1, "the same text", "en")] * 500 + [(i, f"text {i}", "en" if i % 2 else "de") for i in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = language.sample(docs, 20).groupBy("lang").count().collect()
    assert {r.lang: r["count"] <= 10 for r in got} == {"en": True, "de": True}


def test_texts_of_a_crowd_meet_others_than_its_leader(spark, monkeypatch):
    """Texts around one passage, in alike pairs; buckets are crowds from two texts on, blocks hold three."""
    monkeypatch.setattr(near_dedup, "FEW", 1)
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for pair in range(8):
        own = [f"u{pair}x{i}" for i in range(20)]
        changed = [w if i % 4 else f"{w}y" for i, w in enumerate(own)]
        rows += [(2 * pair, " ".join(passage + own)), (2 * pair + 1, " ".join(passage + changed))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {i: (i - i % 2, 1) for i in range(16)}


def test_parities_differ_in_no_more_bins_than_words():
    rng = np.random.default_rng(17)
    for _ in range(200):
        a = rng.integers(0, int(rng.choice([20, 1 << 40])), int(rng.integers(1, 2000)), dtype=np.uint64)
        b = a.copy()
        b[rng.choice(len(a), len(a) // 5, replace=False)] = rng.integers(0, 1 << 40, dtype=np.uint64)
        b = b[: len(b) - int(rng.integers(len(b)))]
        x, y = near_dedup.parities(a), near_dedup.parities(b)
        assert len(x) == near_dedup.PARITY_LONGS
        bins = sum(int(n).bit_count() for n in (x ^ y).view(np.uint64))
        assert bins <= len(a) + len(b) - 2 * near_dedup.words_in_common(a, b)


def test_texts_of_some_ids(spark):
    """Ids of either sign, copies and others that have the same bit."""
    near = near_dedup.ID_BITS
    rows = [(i, bytes([i % 7])) for i in (-5, -5, 3, 3 + near, 9, -near, 1 << 62)]
    texts = spark.createDataFrame(rows, "id bigint, words binary")
    ids = spark.createDataFrame([(i,) for i in (-5, 3, -near, 1 << 62, 77)], "id bigint")
    assert sorted(r.id for r in near_dedup.of_ids(texts, ids).collect()) == [-near, -5, 3, 1 << 62]
    assert near_dedup.of_ids(texts, ids.limit(0)).count() == 0


def test_crowds_around_a_base_give_no_pairs_of_unlike_texts(spark, monkeypatch):
    """Each has 18 % of a base's words replaced: two have 67 % in common and agree in more draws than is asked for."""
    monkeypatch.setattr(near_dedup, "FEW", 1)
    rng = np.random.default_rng(18)
    base = [f"b{i}" for i in range(300)]
    texts = []
    for k in range(40):
        text = base[:]
        for at in rng.choice(300, 54, replace=False):
            text[at] = f"u{k}x{at}"
        texts.append(text)
    # Two of them that are alike.
    texts.append([w if i % 10 else f"z{i}" for i, w in enumerate(texts[7])])
    compared, confirmed = [], near_dedup.confirmed

    def counted(pairs, *more):
        compared.append(pairs.count())
        return confirmed(pairs, *more)

    monkeypatch.setattr(near_dedup, "confirmed", counted)
    docs = spark.createDataFrame([(i, " ".join(text)) for i, text in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {i: i for i in range(40)} | {40: 7}
    assert len(compared) == 3 and compared[2] <= 20


@pytest.mark.parametrize("block", [2, 4096])
def test_texts_of_a_crowd_meet_whatever_follows_the_drawn_word(spark, monkeypatch, block):
    """Every fifth word is replaced, so no eight words in a row are the same; buckets are crowds from two texts on."""
    monkeypatch.setattr(near_dedup, "FEW", 1)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "ROWS", 2)
    rows = []
    for pair in range(6):
        own = [f"u{pair}x{i}" for i in range(60 + 10 * pair)]
        changed = [w if (i + 1) % 5 else f"{w}y" for i, w in enumerate(own)]
        rows += [(2 * pair, " ".join(own)), (2 * pair + 1, " ".join(changed))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {i: (i - i % 2, 1) for i in range(12)}


def test_cells_of_a_crowd_hold_all_pairs(monkeypatch):
    monkeypatch.setattr(near_dedup, "ROWS", 3)
    rng = np.random.default_rng(19)
    base = rng.integers(0, 1 << 40, 400, dtype=np.uint64)
    texts = []
    for _ in range(60):
        text = base[: int(rng.integers(200, 400))].copy()
        text[rng.random(len(text)) < rng.choice([0.05, 0.1, 0.2])] = rng.integers(0, 1 << 40, dtype=np.uint64)
        texts.append(text)
    rows = {
        "id": rng.permutation(60), "n": np.array([len(t) for t in texts]), "class": rng.integers(0, 4, 60),
        "near": np.array([near_dedup.signature(near_dedup.drawn(t)[1]).view(np.uint64) for t in texts]),
        "parities": [near_dedup.fitted(t).view(np.uint64) for t in texts],
    }
    assert len({len(p) for p in rows["parities"]}) > 1
    rows["major"] = rows["class"] == 0
    left = np.flatnonzero(~rows["major"])
    got = [(int(x), int(y)) for a, b in near_dedup.alike_in(rows, left, np.arange(60), 0.8) for x, y in zip(a, b, strict=True)]
    wanted = set()
    for i in range(60):
        for j in range(60):
            alike = near_dedup.words_in_common(texts[i], texts[j]) >= 0.8 * max(len(texts[i]), len(texts[j]))
            if rows["class"][i] != rows["class"][j] and rows["id"][i] > rows["id"][j] and alike:
                wanted.add((int(rows["id"][i]), int(rows["id"][j])))
    found = {(max(p), min(p)) for p in got}
    assert len(found) == len(got) and len(wanted) > 100
    assert len(wanted - found) <= 0.01 * len(wanted)
