"""The corpus pipeline: documents in, a clean, de-duplicated and mixed training set out."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession

from quarrystone.llm.common import checkpoint_folder, remove_folder, table
from quarrystone.llm.stages import STAGES

#: Scoring segments and fingerprint components can't be written in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the stages make of ``documents``; each stage but the last is written to the shared folder and read again, and its predecessor's folder deleted."""
    docs = table(spark, sf_dir, "documents")
    folder = posixpath.join(checkpoint_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(path := posixpath.join(folder, name))
        if before:
            remove_folder(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
