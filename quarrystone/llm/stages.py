"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns documents.

All but the last return exactly the columns they were given. Stages that filter
keep every row they do not reject, with its values as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import checkpointed, free_name, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic by a model fitted to the labels of the documents given."""
    from quarrystone.llm.toxicity import fit, keep_clean

    return keep_clean(docs, fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are alike by 0.8 or more: that of the smallest id, then of the least hash of the text.

    Rows without an id stand behind all others. Rows that share an id but not their texts stand each for itself; of
    rows that repeat both one stays.
    """
    from quarrystone.llm.similar import least_rows

    row, hashed = free_name(docs.columns, "__row"), free_name(docs.columns, "__hash")
    th = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    # rows without an id get one far above all ids
    marked = docs.withColumns({row: F.coalesce(F.col("doc_id").cast("long"), th.bitwiseAND(F.lit((1 << 61) - 1)) + (1 << 61)), hashed: th})
    kept = checkpointed(least_rows(marked.select(F.col(row).alias("id"), F.col(hashed).alias("th"), "text")))
    one = marked.join(kept.select(F.col("id").alias(row), F.col("th").alias(hashed)), [row, hashed], "left_semi").dropDuplicates([row, hashed])
    return one.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    from quarrystone.llm.decontaminate import keep_clean

    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced by a mark."""
    from quarrystone.llm.secrets import redact

    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target shares of their sources, globally shuffled; adds copy and order_key."""
    from quarrystone.llm.mixing import mix
    from quarrystone.llm.queries import SHARES

    return mix(docs, SHARES)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets), ("mixing", mixing)]
