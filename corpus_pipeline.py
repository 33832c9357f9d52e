"""A training-corpus pipeline: quality filter, line dedup, near-duplicate removal, decontamination, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.decontaminate import leaks_by_row, row_key
from tidemark.llm.line_dedup import line_dedup
from tidemark.llm.ngram_join import similar_documents
from tidemark.llm.packing import pack_documents
from tidemark.llm.quality import fit_quality, score_quality
from tidemark.plans.lineage import scratch, spent


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model).filter("predicted = 1").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that 10 documents and more share go; n_chars follows the text."""
    return line_dedup(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a 5-gram Jaccard similarity of 0.8 and more, the smallest doc_id stays.

    Rows that share a doc_id are one document: the longest text stays. Rows
    with a null doc_id and empty documents stay as they are.
    """
    found = similar_documents(docs, n=5, num=80, den=100).filter("component_id is null or doc_id = component_id").select(F.col("doc_id").alias("__id")).distinct()
    kept = docs.join(found, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    if docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").head(1):
        order = Window.partitionBy("doc_id").orderBy(F.desc_nulls_last(F.char_length("text")), "text")
        kept = kept.withColumn("__rank", F.row_number().over(order)).filter("__rank = 1 or doc_id is null").drop("__rank")
    return kept.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copied or edited benchmark item go; rows with a null doc_id are judged one by one."""
    leaks = leaks_by_row(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("id").alias("__id"), F.col("key").alias("__key")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & row_key(F.col("doc_id"), F.col("text")).eqNullSafe(F.col("__key"))
    return docs.join(leaks, same, "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences along the Hilbert curve, one row for each piece of a document."""
    pieces = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", quality),
    ("line_dedup", lines),
    ("ngram_jaccard", near_duplicates),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: Trained scores and alignments have no SQL form; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over all documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        kept = scratch(spark)
        with spent(spark):  # what a stage cuts for itself goes once its result is written
            stage(spark, docs, sf_dir).write.parquet(kept)
        docs = spark.read.parquet(kept)
    return STAGES[-1][1](spark, docs, sf_dir)
