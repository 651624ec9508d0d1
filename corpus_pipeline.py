"""A corpus pipeline of five stages: quality, language, exact dedup, near-dedup, packing.

Each stage takes the documents that its predecessor kept, written as Parquet, and
decides by row: rows that share a doc_id, or have none, are documents of their own
(:func:`lodestrata.llm.common.numbered`), and of equal ones only the first stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import exact_dedup, language_id, minhash_dedup, packing, quality
from lodestrata.llm.common import free_name, materialise, numbered, small_enough

#: Similarity in hundredths from which documents are near copies here; op1's query asks for a stricter cut of its own.
NEAR_PERCENT = 80


def without(docs: DataFrame, row: str, rejected: DataFrame) -> DataFrame:
    """``docs`` less the rows whose number is in ``rejected`` (one column), and less the numbers; texts are shuffled only if those are too many to broadcast."""
    name = free_name(docs, "_rejected")
    ids = materialise(rejected.toDF(name), "rejected")
    ids = F.broadcast(ids) if small_enough(ids) else ids
    return docs.join(ids, F.col(row) == F.col(name), "left_anti").drop(row)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, row = numbered(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return without(own, row, quality.score_documents(own, labels, row=row).filter("predicted = 0").select(row))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # A document's ``lang`` is what the model learns from, and no evidence for the document itself.
    own, row = numbered(docs)
    return without(own, row, language_id.document_languages(own, doc_id=row, use_declared=False).filter("not accepted").select("doc_id"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, row = numbered(docs)
    return without(own, row, exact_dedup.exact_duplicates(own, doc_id=row).filter("not kept").select("doc_id"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, row = numbered(docs)
    return without(own, row, minhash_dedup.near_duplicates(own, doc_id=row, percent=NEAR_PERCENT).filter("not kept").select("doc_id"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("quality classifier", quality_stage), ("language ID", language_stage), ("exact dedup", exact_stage), ("MinHash near-dedup", near_stage), ("best-fit packing", packing_stage)]

#: SQL can't express the classifiers, MinHash and packing stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
