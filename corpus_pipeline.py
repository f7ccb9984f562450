"""Training-data pipeline: each stage calls one operator of ``tesoro.llm`` on all that
its predecessor kept. ``run`` writes every stage's result to the shared folder and
hands the written table to the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesoro.llm.common import prepare, read, store
from tesoro.llm.decontaminate import decontaminate
from tesoro.llm.mixture import mix
from tesoro.llm.simhash import drop_near_duplicates
from tesoro.llm.token_output import token_output
from tesoro.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model calls toxic go; it is fitted on ``labels``."""
    prepare(spark)
    return drop_toxic(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: the one with the smallest id."""
    prepare(spark)
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat a window of a benchmark item are cut out of the texts; all
    documents stay."""
    prepare(spark)
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The target mixture, without repeats: a document is taken once or not at all."""
    prepare(spark)
    return mix(docs, max_epochs=1).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in Re-Pair shard files, read back: a row for each document."""
    prepare(spark)
    return token_output(docs)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixing),
    ("token_output", token_ids),
]

# A tokenizer, fitted models and iterative components: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, from the whole ``documents`` table."""
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
