"""A corpus pipeline: each stage takes (spark, docs, sf_dir) and works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphlift.llm import frames, stages

STAGES = [
    ("language_id", stages.language_id),
    ("toxicity", stages.toxic),
    ("jaccard_join", stages.near_copies),
    ("mixing", stages.mixed),
    ("bpe", stages.bpe_ids),
]

#: No stage is SQL: tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`; each result is written as Parquet and read again by the next."""
    docs = frames.read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = frames.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
