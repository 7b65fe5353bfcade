"""Physical plans: what must and must not be in them."""

from datetime import datetime

import pytest

from bidflow.checks import QUERIES
from bidflow.checks.domain import Domain
from bidflow.operators import lookups

SMALL = "/root/testdata/sf0.001"

# Queries whose work is not in the plan they return (it ran while building it).
STREAMS = {name for name in QUERIES if name.startswith("stream_")}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def domain(spark):
    return Domain(spark, SMALL)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS))
def test_no_cross_joins_and_no_python_rows(domain, name):
    text = plan(QUERIES[name](domain))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in text


def test_since_reads_only_its_partitions_and_columns(spark, domain):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    text = plan(lookups.since(domain.bids_by_year, 3, datetime(1999, 6, 1)).select("id", "title"))
    assert "PartitionFilters: [isnotnull(created_part" in text
    assert "GreaterThanOrEqual(created_at,1999-06-01" in text and "EqualTo(source_id,3)" in text
    assert "ReadSchema: struct<id:bigint,source_id:bigint,title:string,created_at:timestamp>" in text


def test_search_is_a_distributed_top_k(domain):
    assert "TakeOrderedAndProject(limit=50" in plan(QUERIES["search_bids"](domain))


def test_windows_over_facts_are_partitioned(domain):
    text = plan(QUERIES["job_durations"](domain))
    assert "Window" in text and "SinglePartition" not in text.split("Window", 1)[1].split("Broadcast")[0]


def test_aggregates_combine_before_the_shuffle(domain):
    for name in ("daily_stats", "source_share", "duplicate_groups", "error_rollup"):
        assert "partial_count" in plan(QUERIES[name](domain))
