"""The queries and the pipeline on the smallest given tables, against brute force where there is no SQL."""

import sys
import time
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bidflow.llm import common, decontamination, line_dedup, near_dedup, queries, stages, toxicity

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    """Input and output of every stage."""
    docs, out = common.table(spark, SMALL, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SMALL).cache()
        out.append((name, docs, after))
        docs = after
    return out


def rows(df):
    return Counter(tuple(r) for r in df.select(*COLUMNS).collect())


def test_stages_are_those_asked_for(steps):
    assert [name for name, _, _ in steps] == [
        "toxicity", "line dedup", "MinHash near-dedup", "benchmark decontamination", "mixing sources to target weights",
    ]
    assert all(after.columns == COLUMNS for _, _, after in steps[:-1])
    assert all(after.count() for _, _, after in steps)


def test_toxic_documents_go_and_others_stay(spark, steps):
    _, before, after = steps[0]
    chain = toxicity.fit(before, common.table(spark, SMALL, "labels").select("doc_id", "toxic"))
    bad = {r.doc_id for r in toxicity.scored(before, chain).where("toxic").collect()}
    assert bad and rows(after) == rows(before.where(~F.col("doc_id").isin(bad)))


def test_shared_lines_go(steps):
    _, before, after = steps[1]
    got = {r.doc_id: (r.text, r.n_chars) for r in after.collect()}
    for r in line_dedup.deduplicated(before).collect():
        assert got[r.doc_id] == ((r.kept_text, len(r.kept_text)) if r.n_dropped else (r.text, r.n_chars))


def test_one_document_of_each_class_stays(steps):
    _, before, after = steps[2]
    first = {r.class_id for r in near_dedup.near_duplicates(before).collect()}
    assert rows(after) == rows(before.where(F.col("doc_id").isin(first)))
    assert after.count() < before.count()


def test_contaminated_documents_go(spark, steps):
    _, before, after = steps[3]
    found = decontamination.with_leaks(before, common.table(spark, SMALL, "benchmark"))
    assert rows(after) == rows(found.where("size(leaks) = 0"))
    items = [" ".join(r.text.lower().split()) for r in common.table(spark, SMALL, "benchmark").collect()]
    assert not any(i in " ".join(r.text.lower().split()) for r in after.collect() for i in items)


def test_the_mix_takes_near_its_targets(steps):
    _, before, after = steps[4]
    per = after.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 0.05 * r.target + 64 for r in per)
    assert after.where("taken > 2 * size or taken = 0").count() == 0
    assert sum((rows(after) - rows(before)).values()) == 0


def test_run_is_all_stages(spark, steps):
    def key(df):
        return sorted((r.doc_id, r.taken) for r in df.collect())

    assert key(corpus_pipeline.run(spark, SMALL)) == key(steps[-1][2])


def test_equal_rows_leave_one(spark):
    text = "some words of a text that two rows have in common with one another"
    rows_ = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (None, text, "en", "a", 5), (None, None, "en", "a", 0), (None, None, "en", "a", 0)]
    docs = spark.createDataFrame(rows_, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = stages.drop_near_duplicates(spark, docs, SMALL).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, ""), (1, text)]


def test_the_mix_gives_equal_rows_once_each(spark):
    text = "some words of a text that rows have in common"
    rows_ = [(1, text, "en", "a", 5)] * 5 + [(None, text, "en", "b", 5)] * 3 + [(2, "a text of its own", "en", "a", 5), (1, text, "en", None, 5)]
    docs = spark.createDataFrame(rows_, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = stages.mix(spark, docs, SMALL).collect()
    of = Counter((r.doc_id, r.source) for r in got)
    assert all(n <= Counter((r[0], r[3]) for r in rows_)[key] for key, n in of.items()) and of[1, "a"] >= 3
    for source in {r.source for r in got}:
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1.5


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_empty_tables_nulls_and_extra_columns(spark, name, stage):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, size string, _key string"
    none = stage(spark, spark.createDataFrame([], schema), SMALL)
    assert none.count() == 0 and none.columns[:5] == stages.COLUMNS
    rows_ = [(None, None, None, None, None, "x", "x", "x"), (None, "", None, None, None, "x", "x", "x"), (1, "one two three", None, None, None, "x", "x", "x")]
    kept = [r.doc_id for r in stage(spark, spark.createDataFrame(rows_, schema), SMALL).collect()]
    assert 1 in kept and len(kept) <= 3


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_the_rest_works_without_this_subpackage(tmp_path):
    import subprocess

    root = Path(corpus_pipeline.__file__).parent
    (tmp_path / "bidflow").mkdir()
    for part in [*root.glob("bidflow/*"), root / "__spark_entry__.py"]:
        if part.name != "llm":
            (tmp_path / part.relative_to(root)).symlink_to(part)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin"})


def test_what_led_to_the_classes_goes_with_its_shuffles(spark, monkeypatch, tmp_path):
    from bidflow import shared

    monkeypatch.setattr(shared, "shared_dir", lambda _: str(tmp_path))
    docs = common.table(spark, SMALL, "documents").select(*COLUMNS)
    kept = stages.drop_near_duplicates(spark, docs, SMALL)
    assert [p.name.rsplit("-", 1)[0] for p in (tmp_path / "bidflow").iterdir()] == ["near-kept"]
    assert 0 < kept.count() < docs.count()

    def shuffled():
        return len(list(Path(spark.sparkContext._jvm.System.getProperty("java.io.tmpdir")).glob("blockmgr-*/*/shuffle_*.data")))

    rows = spark.range(1000).repartition(7)
    before = shuffled()
    counts = shared.staged(rows.groupBy(F.col("id") % 10).count(), "counts")
    for _ in range(50):
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before and counts.count() == 10
    # Other actions keep theirs, as the session has it.
    assert spark.conf.get(shared.SHUFFLES_GO) == "false"
