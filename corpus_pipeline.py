"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns what it kept; all but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tocsin.llm import common, jaccard, packing, pii, quality, toxicity
from tocsin.llm.queries import WORD_BPE, table, tokenizer


#: What near-duplicates are in this pipeline, as in the contract of op 10: n-grams of so many words, and so many percent in common.
NEAR_WORDS, NEAR_PERCENT = 4, 85


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base test and the learned decision list keep.

    A null or empty text has no words and goes; repeated rows and rows of one doc_id, or of none, are judged row by row.
    """
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic.

    A null or empty text is no sentence and stays; rows are judged one by one, whatever their doc_id.
    """
    return toxicity.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicates: that of the smallest doc_id, a null one last; rows like no other stay.

    Rows are told apart by a key of their own, in a column that ``docs`` doesn't have, so repeated rows are copies of one
    another. Null, empty and blank texts are like no other.
    """
    key = common.unused(docs, "row_key")
    keyed = common.stored(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    found = jaccard.near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), NEAR_WORDS, NEAR_PERCENT).select(F.col("doc_id").alias("key"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    stays = found.join(keyed.select(F.col(key).alias("key"), "doc_id"), "key").groupBy("component_id").agg(first.alias("first")).select(F.col("first.key").alias(key))
    return keyed.join(stays, key, "left_semi").select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; null and empty texts, and repeated rows, as they are."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens; null and empty texts are one end id, repeated rows are packed each."""
    return packing.pack(docs, tokenizer(WORD_BPE), end_id=1, capacity=4096)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_documents),
    ("n-gram join", near_duplicates),
    ("personal data", personal_data),
    ("packing", packed),
]

#: SQL can't express the learned stages, nor packing; tests hold each stage against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
