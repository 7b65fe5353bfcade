"""Joins, duplicates, rules, reports, schedules against plain Python."""

import json
import random
from collections import defaultdict
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import rows as R
from bidflow import schemas
from bidflow.operators import classify, dedup, integrity, lookups, near, reports, rules, schedule
from bidflow.operators.skew import attach_group, left_join_optional, salted_join
from bidflow.plans.export import DEFAULT_COLUMNS, export_view, run_exports
from bidflow.plans.health import health_report


def config(spark, entries):
    """(code, is_active, data) tuples."""
    full = [(i, code, code, on, json.dumps(data), R.T0, R.T0) for i, (code, on, data) in enumerate(entries)]
    return spark.createDataFrame(full, schemas.CONFIG)


# --- large keys ---


@pytest.mark.parametrize("how", ["left", "inner"])
def test_attach_group_with_a_key_holding_most_rows(spark, how):
    data = [(i, "hot" if i % 3 else (None if i % 2 else f"k{i % 50}")) for i in range(3000)]
    rows = spark.createDataFrame(data, "id long, key string")
    groups = rows.where("key is not null and key <> 'k0'").groupBy("key").agg(
        F.count("*").alias("n_rows"), F.min("id").alias("first")
    )
    first = {}
    for i, k in data:
        if k is not None and k != "k0":
            first.setdefault(k, i)
    got = {r.id: r.first for r in attach_group(rows, groups, ["key"], how, hot_rows=100).collect()}
    expected = {i: first.get(k) for i, k in data if how == "left" or k in first}
    assert got == expected


def test_salted_join_slices_only_large_keys(spark):
    rows = spark.range(1000).withColumn("k", F.when(F.col("id") < 900, 0).otherwise(F.col("id") % 7 + 1))
    unique = spark.range(8).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    sizes = rows.groupBy("k").agg(F.count("*").alias("n_rows"))
    joined = salted_join(rows, unique, sizes, ["k"], hot_rows=50)
    assert joined.count() == 1000 and joined.where("v <> k * 10").count() == 0


def test_left_join_optional_keeps_rows_without_reference(spark):
    child = spark.createDataFrame([(1, 5), (2, None), (3, 9)], "id long, ref long")
    parent = spark.createDataFrame([(5, "five")], "pid long, name string")
    assert {r.id: r.name for r in left_join_optional(child, parent, "ref", "pid").collect()} == {1: "five", 2: None, 3: None}


# --- duplicates ---


def test_candidates_include_the_bid_itself_and_null_matches_null(spark):
    stored = R.bids(spark, [
        {"external_id": "a"}, {"external_id": None}, {"external_id": None}, {"external_id": None, "source_id": 2}, {"external_id": ""},
    ])
    got = {r.id: (r.n_candidates, r.first_id) for r in dedup.duplicate_candidates(stored, hot_rows=2).collect()}
    assert got == {1: (1, 1), 2: (2, 2), 3: (2, 2), 4: (1, 4), 5: (1, 5)}
    probe = stored.where("id = 3")
    assert sorted(r.id for r in dedup.candidates_of(stored, probe).collect()) == [2, 3]
    assert [r.id for r in dedup.candidates_of(stored, stored.where("id = 1")).collect()] == [1]


@pytest.mark.parametrize("keep", ["first", "last"])
def test_mark_duplicates(spark, keep):
    data = [
        {"external_id": None if i % 11 == 0 else f"e{i % 4 if i % 3 else 0}", "source_id": i % 2, "created_at": R.T0 + timedelta(hours=i * 7 % 13)}
        for i in range(200)
    ]
    marked = dedup.mark_duplicates(R.bids(spark, data), ["source_id", "external_id"], keep=keep, hot_rows=20)
    groups = defaultdict(list)
    for i, row in enumerate(data):
        if row["external_id"] is not None:
            groups[row["source_id"], row["external_id"]].append((row["created_at"], i + 1))
    originals = {(min if keep == "first" else max)(g)[1] for g in groups.values()}
    got = marked.collect()
    assert len(got) == 200
    for r in got:
        assert r.is_duplicate == (r.external_id is not None and r.id not in originals)
        assert (r.dedup_key is None) == (r.external_id is None)


def test_windows_separate_duplicates_in_time(spark):
    stored = R.bids(spark, [{"created_at": datetime(1970, 1, 1)}, {"created_at": datetime(1970, 1, 9)}, {"created_at": datetime(1970, 1, 11)}])
    marked = dedup.mark_duplicates(stored, ["title"], window_days=10)
    assert [r.is_duplicate for r in marked.orderBy("id").collect()] == [False, True, False]


def test_payload_duplicates(spark):
    items = R.raw_items(spark, [(1, 1, "a", "x"), (2, 2, None, "x"), (3, 1, "b", "y"), (4, 1, "c", "x ")])
    (group,) = dedup.payload_duplicates(items).collect()
    assert (group.n_items, group.first_id, group.n_bytes) == (2, 1, 1)


def words_of(seed, n):
    return [f"w{(seed * 7919 + i * 104729) % 100003}" for i in range(n)]


def triples(words):
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))}


def alike(a, b):
    x, y = triples(a), triples(b)
    return len(x & y) / len(x | y)


def expected_groups(texts, gates, threshold):
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if gates[i] == gates[j] and alike(texts[i], texts[j]) >= threshold:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i + 1: root(i) + 1 for i in range(len(texts))}


def test_near_duplicates_against_all_pairs(spark):
    texts, gates = [], []
    for family in range(8):
        base = words_of(family, 120)
        for copy in range(6):
            changed = list(base)
            if copy >= 2:
                changed[copy * 9] = f"typo{family}x{copy}"
            texts.append(changed)
            gates.append("A" if copy != 5 else "B")
    texts += [["single"], ["single"], ["two", "words"], words_of(99, 40)]
    gates += ["A"] * 4
    stored = R.bids(spark, [{"description": " ".join(t), "load_location": g} for t, g in zip(texts, gates)])
    for hot in (3, 10**6):
        got = near.near_duplicates(stored, threshold=0.8, hot_rows=hot).collect()
        assert {r.id: r.group_id for r in got} == expected_groups(texts, gates, 0.8)
        assert all(r.is_near_duplicate == (r.id != r.group_id) for r in got)


def adversarial(kind, rng):
    """Texts around a passage that most of them share, families of close copies, and sets near the limit."""
    passage = words_of(1, 80)
    if kind == "passage":
        # Between nothing and nearly all of a text is the passage.
        return [passage[: 80 - i % 30] + words_of(100 + i, 2 + (i * 7) % 40) for i in range(90)]
    if kind == "families":
        out = []
        for family in range(6):
            base = words_of(200 + family, 30 + 25 * family)
            for _ in range(14):
                copy = [w if rng.random() > 0.02 else f"x{rng.randrange(10**6)}" for w in base]
                out.append(copy[: len(copy) - rng.randrange(4)])
        return out
    if kind == "few words":
        return [[rng.choice("abcd") for _ in range(rng.randrange(1, 12))] for _ in range(150)]
    base = [f"w{rng.randrange(25)}" for _ in range(60)]
    return [base[rng.randrange(8) : 60 - rng.randrange(8)] + [f"y{rng.randrange(3)}"] * rng.randrange(3) for _ in range(100)]


@pytest.mark.parametrize(
    ("kind", "few"), [("passage", 1), ("families", 1), ("families", 32), ("few words", 1), ("near the limit", 1)]
)
def test_near_duplicates_of_adversarial_texts(spark, monkeypatch, kind, few):
    rng = random.Random(f"{kind}")
    texts = adversarial(kind, rng)
    stored = R.bids(spark, [{"description": " ".join(t)} for t in texts])
    links = near.near_links
    monkeypatch.setattr(near, "near_links", lambda *args: links(*args, few=few))
    got = {r.id: r.group_id for r in near.near_duplicates(stored, threshold=0.8, price_tolerance=None).collect()}
    assert got == expected_groups(texts, ["A"] * len(texts), 0.8)


def test_a_common_passage_is_no_meeting_point(spark):
    passage = " ".join(words_of(1, 80))
    texts = spark.createDataFrame([(i, passage + " " + " ".join(words_of(100 + i, 30))) for i in range(60)], "id long, text string")
    texts = texts.select("id", F.lit("g").alias("gate"), F.split("text", " ").alias("words"))
    points = near.meeting_points(texts.select("id", "gate", near.shingles(F.col("words")).alias("shingles")), 0.8)
    lying = points.where("not as_longer").groupBy("bucket").count()
    assert lying.where("count > 1").count() == 0


def test_texts_without_a_possible_partner_are_left_out(spark, monkeypatch):
    texts = [words_of(1, 80) + words_of(100 + i, 30) for i in range(60)]
    texts += [words_of(7, 90), [*words_of(7, 90)[:-1], "other"], words_of(7, 90), ["two", "words"], ["two", "words", "more"], ["x"]]
    monkeypatch.setattr(near, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(near, "PART_BYTES", 500)
    rows = [(i, "g", " ".join(text)) for i, text in enumerate(texts)] + [(70, "h", " ".join(words_of(7, 90))), (71, "g", ""), (72, "g", None)]
    # Rows of one key are one text.
    rows += [rows[0], (73, "g", "x y z x y z"), (73, "g", "x y z x y z")]
    frame = spark.createDataFrame(rows, "key long, gate string, text string").repartition(5)
    assert sorted(r.key for r in near.likely_texts(frame, 0.8).collect()) == [60, 61, 62, 71, 72]
    # What is compared further are those only.
    seen = []
    points = near.meeting_points
    monkeypatch.setattr(near, "meeting_points", lambda rows, *args: seen.append(rows.count()) or points(rows, *args))
    got = {r.id: r.group_id for r in near.near_duplicates(R.bids(spark, [{"description": " ".join(t)} for t in texts])).collect()}
    assert got == expected_groups(texts, ["A"] * len(texts), 0.8)
    assert seen == [2]


def test_near_duplicates_respect_prices_and_fold_floods_of_copies(spark):
    text = " ".join(words_of(5, 60))
    data = [{"description": text, "price_value": Decimal(100)} for _ in range(300)]
    data += [{"description": text + " end", "price_value": Decimal(105)}, {"description": text + " fin", "price_value": Decimal(300)}]
    data += [{"description": text + " x", "price_value": None}]
    got = {r.id: r.group_id for r in near.near_duplicates(R.bids(spark, data), hot_rows=10).collect()}
    assert {got[i] for i in range(1, 302)} == {1}
    assert got[302] == 302 and got[303] == 303


def test_long_chains_become_one_group(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(101, 100)], "id long, leader long")
    got = {r.id: r.group_id for r in near.connected_groups(edges, hot_rows=5).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# --- integrity ---


def tables(spark):
    src = R.sources(spark, [(1, "a", "A", True), (2, "b", "B", True)])
    raw = R.raw_items(spark, [(1, 1, "x", "p"), (2, 2, "y", "p"), (3, 7, "z", "p")])
    bids = R.bids(spark, [{"source_id": 1, "raw_item_id": 2}, {"source_id": 1, "raw_item_id": None}, {"source_id": 1, "raw_item_id": 50}])
    jobs = spark.createDataFrame([(1, 2, "harvest", "done", R.T0, R.T0, 1, 1, 0, None, R.T0)], schemas.JOBS)
    errors = spark.createDataFrame([(1, 2, 1, R.T0, "error", "m", None, R.T0), (2, None, 9, R.T0, "error", "m", None, R.T0)], schemas.ERRORS)
    return {"sources": src, "raw_items": raw, "bids": bids, "jobs": jobs, "errors": errors}


def test_orphans(spark):
    found = {(r.reference, r.child_id, r.parent_id) for r in integrity.foreign_key_orphans(tables(spark)).collect()}
    assert found == {("raw_items.source_id", 3, 7), ("bids.raw_item_id", 3, 50), ("errors.job_id", 2, 9)}


def test_deleting_sources(spark):
    all_tables = tables(spark)
    gone = spark.createDataFrame([(2,)], "id long")
    effects = {(r.reference, r.effect, r.child_id) for r in integrity.delete_effects(all_tables, "sources", gone).collect()}
    assert effects == {
        ("raw_items.source_id", "deleted", 2), ("bids.raw_item_id", "set_null", 1),
        ("jobs.source_id", "set_null", 1), ("errors.source_id", "set_null", 1),
    }
    left = integrity.delete_sources(all_tables, gone)
    assert [r.id for r in left["sources"].collect()] == [1]
    assert sorted(r.id for r in left["raw_items"].collect()) == [1, 3]
    assert {r.id: r.raw_item_id for r in left["bids"].collect()} == {1: None, 2: None, 3: 50}
    assert left["jobs"].first().source_id is None
    assert {r.id: r.source_id for r in left["errors"].collect()} == {1: None, 2: None}
    with pytest.raises(ValueError, match="bids"):
        integrity.delete_sources(all_tables, spark.createDataFrame([(1,)], "id long"))


def test_retention_prunes_and_releases(spark):
    raw = R.raw_items(spark, [(1, 1, "x", "p"), (2, 1, "y", "p")]).withColumn(
        "created_at", F.col("created_at") + F.make_dt_interval((F.col("id") * 10).cast("int"))
    ).withColumn("created_part", F.to_date("created_at"))
    stored = R.bids(spark, [{"raw_item_id": 1}, {"raw_item_id": 2}])
    kept, bids = integrity.retention(raw, stored, datetime(2025, 1, 15))
    assert [r.id for r in kept.collect()] == [2]
    assert {r.id: r.raw_item_id for r in bids.collect()} == {1: None, 2: 2}


def test_constraint_audit_finds_each_kind(spark):
    src = spark.createDataFrame(
        [(1, "a", "n", "html", True, None, R.T0, R.T0), (2, "a", None, "x" * 51, True, None, R.T0, R.T0)], schemas.SOURCES.simpleString()
    )
    found = {(r.column_name, r.rule): r.violations for r in integrity.constraint_audit({"sources": src}).collect()}
    assert {k: v for k, v in found.items() if v} == {("name", "not_null"): 1, ("kind", "max_length"): 1, ("code", "unique"): 1}


# --- rules ---


def test_rules_modes_nulls_and_sources(spark):
    stored = R.bids(spark, [
        {"cargo_type": "sand", "price_value": Decimal(100), "load_region": None},
        {"cargo_type": "sand", "price_value": None, "load_region": "north"},
        {"cargo_type": None, "price_value": Decimal(500), "load_region": "south"},
        {"cargo_type": "sand", "price_value": Decimal(10), "source_id": 2},
    ])
    table = config(spark, [
        ("floor", True, {"mode": "include", "field": "price_value", "op": "ge", "values": ["50"], "sources": ["a"]}),
        ("north", True, {"mode": "exclude", "field": "load_region", "op": "in", "values": ["north"]}),
        ("off", False, {"mode": "exclude", "field": "title", "op": "rlike", "values": ["."]}),
    ])
    src = R.sources(spark, [(1, "a", "A", True), (2, "b", "B", True)])
    judged = rules.filter_bids(stored, table, src)
    assert {r.id: r.reasons for r in judged.collect()} == {1: [], 2: ["floor", "north"], 3: ["cargo_type_missing"], 4: []}
    assert sorted(r.id for r in rules.kept(judged).collect()) == [1, 4]
    with pytest.raises(ValueError, match="unknown sources"):
        rules.filter_bids(stored, table)
    lost = config(spark, [("floor", True, {"mode": "include", "field": "price_value", "op": "ge", "values": ["50"], "sources": ["nowhere"]})])
    with pytest.raises(ValueError, match="nowhere"):
        rules.filter_bids(stored, lost, src)


def test_rules_name_only_bid_fields(spark):
    table = config(spark, [("x", True, {"mode": "include", "field": "id) or (1=1", "op": "in", "values": []})])
    with pytest.raises(ValueError, match="unknown bid field"):
        rules.filter_bids(R.bids(spark, [{}]), table)


def test_bid_messages(spark):
    messages = spark.createDataFrame([("Нужен САМОСВАЛ завтра",), ("самосвальный",), ("песок  строительный 20т",), ("a.b",), ("axb",)], "text string")
    found = rules.bid_messages(messages, ["самосвал", "песок строительный", "a.b"])
    assert [r.text for r in found.collect()] == ["Нужен САМОСВАЛ завтра", "песок  строительный 20т", "a.b"]


def test_classify_by_priority(spark):
    table = config(spark, [
        ("b", True, {"target": "cargo_type", "value": "щебень", "priority": 2, "keywords": ["щебень"]}),
        ("a", True, {"target": "cargo_type", "value": "песок", "priority": 2, "keywords": ["песок", "речной песок"]}),
        ("t", True, {"target": "transport_type", "value": "тонар", "priority": 1, "regex": "(?iu)тонар"}),
    ])
    stored = R.bids(spark, [
        {"title": "Щебень, песок", "description": "Тонары"}, {"title": "щебень"}, {"title": "песочный"}, {"title": "песок", "cargo_type": "уголь"},
    ])
    got = classify.classify(stored, table).orderBy("id").collect()
    assert [r.cargo_type for r in got] == ["песок", "щебень", None, "уголь"]
    assert [r.transport_type for r in got] == ["тонар", None, None, None]


# --- reports and schedules ---


def jobs(spark, rows):
    """(id, source_id, minute, status, seconds) tuples."""
    full = [
        (i, s, "harvest", st, R.T0 + timedelta(minutes=m), R.T0 + timedelta(minutes=m, seconds=sec), 1, 1, 0, None, R.T0)
        for i, s, m, st, sec in rows
    ]
    return spark.createDataFrame(full, schemas.JOBS)


def test_job_durations_across_blocks(spark):
    data = [(i, 1 if i % 4 else 2, i, "done", (i * 37) % 101) for i in range(1, 301)]
    got = {r.id: (r.previous_runs, r.mean_us) for r in reports.job_durations(jobs(spark, data), previous=5, block=16).collect()}
    past, expected = defaultdict(list), {}
    for i, s, _, _, sec in data:
        last = past[s][-5:]
        expected[i] = (len(last), sum(last) * 1e6 / len(last) if last else None)
        past[s].append(sec)
    assert got.keys() == expected.keys()
    for i, (n, mean) in expected.items():
        assert got[i][0] == n and (got[i][1] is None if mean is None else abs(got[i][1] - mean) < 1e-3)


def test_slow_jobs(spark):
    data = [(i, 1, i, "done", 10) for i in range(1, 6)] + [(6, 1, 6, "done", 25), (7, 1, 7, "done", 12)]
    alerts = reports.slow_jobs(reports.job_durations(jobs(spark, data)), factor=2.0)
    assert [r.id for r in alerts.collect()] == [6]


def test_due_sources(spark):
    src = R.sources(spark, [(1, "ok", "", True), (2, "failing", "", True), (3, "never", "", True), (4, "off", "", False), (5, "unplanned", "", True)])
    plan = {"interval_minutes": 10, "backoff_factor": 2.0, "max_backoff_minutes": 60}
    table = config(spark, [(c, True, {"source_code": c, **plan}) for c in ("ok", "failing", "never", "off")])
    runs = jobs(spark, [(1, 1, 0, "failed", 1), (2, 1, 5, "done", 1), (3, 2, 0, "done", 1), (4, 2, 1, "failed", 1), (5, 2, 2, "failed", 1)])
    state = schedule.job_state(runs, hot_rows=1)
    assert {r.source_id: r.failures for r in state.collect()} == {1: 0, 2: 2}

    def due(minute):
        found = schedule.due_sources(src, state, table, R.T0 + timedelta(minutes=minute))
        return sorted(r.code for r in found.collect())

    assert due(14) == ["never"]
    assert due(15) == ["never", "ok"]
    assert due(41) == ["never", "ok"]
    assert due(42) == ["failing", "never", "ok"]
    assert [r.code for r in schedule.unreachable_sources(src, state, 2).collect()] == ["failing"]


def test_silent_sources(spark):
    src = R.sources(spark, [(1, "quiet", "", True), (2, "never", "", True), (3, "loud", "", True), (4, "off", "", False)])
    stored = R.bids(spark, [{"source_id": 1, "created_at": R.T0}, {"source_id": 3, "created_at": R.T0 + timedelta(hours=4)}])
    found = reports.silent_sources(src, stored, R.T0 + timedelta(hours=5), 2)
    assert {r.code: r.last_bid_at for r in found.collect()} == {"quiet": R.T0, "never": None}


def test_daily_stats_totals(spark):
    t = tables(spark)
    got = {(r.level, r.day, r.source_id): (r.raw_items, r.bids, r.errors) for r in reports.daily_stats(t["raw_items"], t["bids"], t["errors"]).collect()}
    day = date(2025, 1, 1)
    assert got[(3, None, None)] == (3, 3, 2) and got[(1, day, None)] == (3, 3, 2)
    assert got[(0, day, 1)] == (1, 3, 0) and got[(0, day, None)] == (0, 0, 1)


def test_health_report_sections(spark):
    t = tables(spark)
    report = health_report(t["sources"], t["raw_items"], t["bids"], t["errors"], date(2025, 1, 1), 24).collect()
    assert {r.section for r in report} == {"counts", "share", "duplicates", "errors", "silent"}
    assert [(r.source_id, r.name) for r in report if r.section == "silent"] == [(2, "b")]


# --- export ---


def test_exports(spark, tmp_path):
    stored = R.bids(spark, [
        {"title": 'quote " and\nline, comma', "price_value": Decimal("5.50"), "external_id": "e1"},
        {"title": "cheap", "price_value": Decimal("1.00"), "external_id": None},
    ])
    table = config(spark, [("min", True, {"mode": "include", "field": "price_value", "op": "ge", "values": ["1"]})])
    assert export_view(stored, table).columns == list(DEFAULT_COLUMNS)
    exports = config(spark, [
        ("all", True, {"format": "csv", "path": "all", "columns": ["external_id", "title", "price_value"], "rules": ["min"]}),
        ("off", False, {"format": "csv", "path": "off"}),
    ])
    paths = run_exports(stored, exports, table, str(tmp_path))
    assert list(paths) == ["all"]
    with pytest.raises(ValueError, match="mni"):
        export_view(stored, table, ["min", "mni"])
    back = spark.read.schema("external_id string, title string, price_value string").csv(
        paths["all"], header=True, escape='"', multiLine=True, nullValue=""
    )
    assert {(r.external_id, r.title, r.price_value) for r in back.collect()} == {
        ("e1", 'quote " and\nline, comma', "5.50"), (None, "cheap", "1.00"),
    }


def test_lookup_by_ids_counts_each_row_once(spark):
    asked = spark.createDataFrame([(1,), (1,), (77,)], "id long")
    assert lookups.by_ids(R.bids(spark, [{}, {}]), asked).count() == 1


def test_several_dedup_strategies_mark_together(spark):
    stored = R.bids(spark, [
        {"title": "a", "external_id": "1"}, {"title": "a", "external_id": "2"}, {"title": "b", "external_id": "2"}, {"title": "c", "external_id": "3"},
    ])
    strategies = [{"keys": ["title"]}, {"keys": ["external_id"], "keep": "last"}]
    marked = dedup.mark_by_all(stored, strategies).orderBy("id").collect()
    assert [r.is_duplicate for r in marked] == [False, True, False, False]
    assert len({r.dedup_key for r in marked}) == 3 and all(r.dedup_key for r in marked)


def test_large_keys_are_listed_without_a_limit(spark):
    rows = spark.range(4000).select("id", (F.col("id") % 2000).cast("string").alias("key"))
    groups = rows.groupBy("key").agg(F.count("*").alias("n_rows"), F.min("id").alias("least"))
    joined = attach_group(rows, groups, ["key"], "inner", hot_rows=2)
    assert joined.count() == 4000 and joined.where("least <> id % 2000").count() == 0
    assert "Limit" not in joined._jdf.queryExecution().executedPlan().toString()


def test_several_dedup_strategies_write_keys_only(spark, monkeypatch):
    written = []
    monkeypatch.setattr(dedup, "staged", lambda df, label: (written.append(set(df.columns)), df)[1])
    rows = [{"description": t, "external_id": e} for t, e in [("a", "1"), ("a", "1"), ("b", None), ("b", "2"), (None, "2"), (None, None)]]
    strategies = [{"keys": ["description"]}, {"keys": ["external_id"], "keep": "last"}, {"keys": ["description", "external_id"], "null_policy": "equal"}]
    marked = dedup.mark_by_all(R.bids(spark, rows), strategies).orderBy("id").collect()
    assert [r.is_duplicate for r in marked] == [True, True, False, True, False, False]
    assert [bool(r.dedup_key) for r in marked] == [True] * 6
    assert marked[0].dedup_key != marked[1].dedup_key and marked[2].dedup_key == marked[3].dedup_key
    assert written == [{"id", "created_at", "_key0", "_key1", "_key2"}]
    assert not any(r.is_duplicate or r.dedup_key for r in dedup.mark_by_all(R.bids(spark, rows), []).collect())


def test_keys_of_several_strategies_are_gone_once_marked(spark, tmp_path, monkeypatch):
    """What marking writes on the way, the keys of all rows above all, does not stay; keys come out as ``dedup_key`` gives them."""
    from bidflow import shared
    from bidflow.functions.keys import dedup_key

    monkeypatch.setattr(shared, "shared_dir", lambda spark: str(tmp_path))
    df = R.bids(spark, [{"title": f"t{i % 3}", "contact_phone": None if i % 4 else "+79"} for i in range(12)])
    how = [{"keys": ["title", "contact_phone"], "null_policy": "equal"}, {"keys": ["contact_phone"], "null_policy": "skip"}]
    got = dedup.mark_by_all(df, how)
    left = sorted(p.name.split("-")[0] for p in (tmp_path / "bidflow").iterdir())
    assert left == ["groups", "groups"]
    keys = df.select("id", dedup_key(df, ["title", "contact_phone"], "equal").alias("a"), dedup_key(df, ["contact_phone"]).alias("b"))
    keys = {r.id: (r.a, r.b) for r in keys.collect()}
    rows = {r.id: r for r in got.collect()}
    assert rows[1].dedup_key == keys[1][0] and not rows[1].is_duplicate
    assert rows[5].is_duplicate and rows[5].dedup_key == keys[5][1]
    assert all(len(r.dedup_key) == 64 for r in rows.values())
