"""Four stages over documents: quality rules, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept; its result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import ngram_join, packing, quality, toxicity
from sparkloom.llm.common import shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def toxic_segments(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic. The model is fitted on those of docs that have labels outside the held-out fold."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group that shares five-word shingles at 0.8 or more."""
    return ngram_join.keep_first(docs, ngram_join.Rule(words=5, num=80, den=100))


def packing_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 ids along the curve, with their ids."""
    return packing.pack(docs)


STAGES = [("quality", quality_rules), ("toxicity", toxic_segments), ("near_duplicates", near_duplicates), ("packing", packing_order)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/sparkloom/{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learnt scores and hashed tokens have no SQL form; tests/llm hold each stage against a plain version.
ORACLE_SQL = None
