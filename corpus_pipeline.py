"""Training-data pipeline over ``documents``: each stage works on all that its predecessor kept.

All stages but the last return the columns of documents. Nulls, repeated rows and empty tables are as the
operators' docstrings say; columns beyond those of documents pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm.language import UNDETERMINED, identify
from siteloom.llm.mixing import mixed_documents
from siteloom.llm.ngram_join import one_of_each
from siteloom.llm.packing import pack
from siteloom.llm.pii import redact

#: A text whose best language scores less looks like none of those learnt.
LEAST_SCORE = 0.1


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, without text, or like no learnt language go."""
    found = identify(docs, keep=tuple(docs.columns))
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id."""
    return one_of_each(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found spans become their kind in brackets; n_chars follows the text."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(spark, docs)


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its bucket, batch and place in the batch."""
    return pack(docs)


STAGES = [("language", known_language), ("near_copies", drop_near_copies), ("personal_data", redact_personal_data), ("mixing", mix), ("packing", batches)]

#: String kernels and min-hash tries are not expressible in SQL; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
