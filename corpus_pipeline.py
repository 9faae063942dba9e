"""A corpus from raw documents to packed sequences, a stage at a time.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return
the columns of documents. Empty tables pass through; nulls and repeats are handled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termweave.llm.common import stage, table
from termweave.llm.mixing import mixed_documents
from termweave.llm.neardup import drop_near_duplicates
from termweave.llm.packing import pack
from termweave.llm.suffixes import without_repeats
from termweave.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def suffix_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A passage of over 50 words goes if it repeats, also one shorter than the bytes of op7_suffixes."""
    return without_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("suffix_duplicates", suffix_duplicates), ("mixing", mixing), ("packing", packing)]

#: Learned scores, signatures and token ids have no SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
