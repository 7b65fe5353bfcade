"""Typed scans of stored tables and configuration seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from bidflow.schemas import CONFIG, TABLES


def read_table(spark: SparkSession, path: str, table: str, partitioned: bool = False) -> DataFrame:
    """One of the twelve tables with its declared schema; nothing is inferred."""
    fields = list(TABLES[table].fields)
    if partitioned:
        fields.append(T.StructField("created_part", T.DateType()))
    return spark.read.schema(T.StructType(fields)).parquet(path)


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """Configuration rows from JSON files, one row per line; ``data`` may be an object.

    Declaring ``data`` a string makes the reader keep the object's JSON text.
    """
    return spark.read.schema(CONFIG).json(path, mode="FAILFAST", timestampFormat="yyyy-MM-dd'T'HH:mm:ss")
