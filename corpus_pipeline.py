"""A training corpus from ``documents``: toxic and poor texts go, one of each group of near copies stays, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.packing import pack_documents
from millrace.llm.quality import clean_documents
from millrace.llm.simhash import one_of_each
from millrace.llm.store import materialize, table
from millrace.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("packing", packing)]

#: Fitted weights, XXH64 and the tokenizer are beyond SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on all that the stage before kept, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
