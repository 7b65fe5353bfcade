"""Every registered query against its SQL twin on the smallest data."""

import pytest

from compare import differences, duck, entry

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_its_twin(spark, con, name):
    rows, problems = differences(spark, con, SMALL, name)
    assert not problems and rows >= 0


def test_entry(spark):
    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())
