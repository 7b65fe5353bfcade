"""Registry of queries over the given tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidflow.checks.domain import Domain

Query = Callable[[Domain], DataFrame]

QUERIES: dict[str, Query] = {}
TWINS: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with the SQL that must give the same rows."""

    def add(fn: Query) -> Query:
        if fn.__name__ in QUERIES:
            raise ValueError(f"query {fn.__name__} is registered twice")
        QUERIES[fn.__name__] = fn
        if sql is not None:
            TWINS[fn.__name__] = sql
        return fn

    return add


def plain(df: DataFrame) -> DataFrame:
    """Types both engines print alike: times as text, decimals as double, whole numbers as bigint."""
    columns = []
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(field.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(field.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        columns.append(c.alias(field.name))
    return df.select(*columns)


def ts(*columns: str) -> str:
    """SQL text of timestamp columns as ``plain`` prints them."""
    return ", ".join(f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') as {c}" for c in columns)


def day(expression: str, name: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d') as {name}"


def dbl(*columns: str) -> str:
    return ", ".join(f"cast({c} as double) as {c}" for c in columns)


def runner(fn: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(fn(Domain(spark, sf_dir)))

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run
