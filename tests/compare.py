"""Run registered queries and their SQL twins side by side.

    python tests/compare.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402

GIVEN = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in GIVEN:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return value


def _rows(names, tuples) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(_cell(t[i]) for i in order)) for t in tuples)


def differences(spark, con, sf_dir: str, name: str, shown: int = 3) -> tuple[int, list[str]]:
    """Row count of the query, and what differs from its twin (empty: equal)."""
    df = entry.queries()[name](spark, sf_dir)
    mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return len(mine), []
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    if sorted(names) != sorted(df.columns):
        return len(mine), [f"columns {sorted(df.columns)} != {sorted(names)}"]
    theirs = _rows(names, result.fetchall())
    if mine == theirs:
        return len(mine), []
    extra = sorted(set(mine) - set(theirs))[:shown]
    missing = sorted(set(theirs) - set(mine))[:shown]
    return len(mine), [f"{len(mine)} rows against {len(theirs)}", *[f"+ {x}" for x in extra], *[f"- {x}" for x in missing]]


def main() -> int:
    from bidflow.shared import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = local_session("8"), duck(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in names or entry.queries():
        start = time.time()
        try:
            rows, problems = differences(spark, con, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            rows, problems = -1, [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(problems)
        twin = "" if name in entry.oracle_sql() else " (rows only)"
        print(f"{'FAIL' if problems else 'ok  '} {name:32} {rows:8} rows {time.time() - start:6.2f}s{twin}", flush=True)
        for line in problems:
            print("     ", line[:1500], flush=True)
    print(f"{bad} failed")
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main())
