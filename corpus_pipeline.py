"""The corpus pipeline: stages from raw documents to a mix of clean ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bidflow.llm.common import table
from bidflow.llm.stages import deduplicate_lines, drop_contaminated, drop_near_duplicates, drop_toxic, mix
from bidflow.shared import cleared, staged

STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", deduplicate_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix),
]

# Models, sketches and alignments have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read back for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        # What a stage has staged goes once its result is written.
        with cleared(spark) as scope:
            docs = scope.keep(staged(stage(spark, docs, sf_dir), name.replace(" ", "-")))
    return STAGES[-1][1](spark, docs, sf_dir)
