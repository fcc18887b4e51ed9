"""Corpus preparation: toxicity, line dedup, near-duplicate documents, decontamination, mixing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame that ``run`` writes to the shared
folder and rereads as the next stage's documents. All stages but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnflow.llm import stages
from tarnflow.llm.storage import cut

STAGES = [
    ("toxicity", stages.toxicity),
    ("line_dedup", stages.line_dedup),
    ("ngram_jaccard", stages.ngram_jaccard),
    ("decontamination", stages.decontamination),
    ("mixing", stages.mixing),
]

#: The first stage's boosted trees are not SQL; tests hold the run against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
