"""Table versions of ``sources`` and the steps between them.

v1: type, base_url, priority. v2: type renamed to kind, description added.
v3: base_url and priority dropped. What a step drops is gone; its reverse
brings the column back with the default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sources_v1_to_v2(v1: DataFrame) -> DataFrame:
    return v1.withColumnRenamed("type", "kind").withColumn("description", F.lit(None).cast("string"))


def sources_v2_to_v1(v2: DataFrame) -> DataFrame:
    return v2.drop("description").withColumnRenamed("kind", "type")


def sources_v2_to_v3(v2: DataFrame) -> DataFrame:
    return v2.drop("base_url", "priority")


def sources_v3_to_v2(v3: DataFrame) -> DataFrame:
    return v3.withColumn("priority", F.lit(0)).withColumn("base_url", F.lit(None).cast("string"))
