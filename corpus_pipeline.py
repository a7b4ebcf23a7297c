"""A training-data pipeline over documents: each stage is written as Parquet and read again by the next.

Stages keep all columns of documents, of any number, and need doc_id and text (lang to learn languages). Null and
blank texts go with the first stage; in a table with null or repeated ids each row is judged by itself. Repeated rows
are near duplicates of each other. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sylvan.llm.common import Scratch, temporary
from sylvan.llm.decontamination import remove_contaminated
from sylvan.llm.language_id import keep_identified
from sylvan.llm.near_dedup import keep_one
from sylvan.llm.packing import pack
from sylvan.llm.secret_scan import redact_secrets


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: null texts and texts without letters go; ties stay by the share of either."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least doc_id; texts without words all stay."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; null texts hold none."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; null texts stay null."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences; a null text is the end id alone."""
    return pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]
#: Stages 1, 2, 4 and 5 use models, signatures and a tokenizer that SQL lacks; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage wrote for itself goes with it, and its result once the next one has read it."""
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with temporary():
            out = scratch.table(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
