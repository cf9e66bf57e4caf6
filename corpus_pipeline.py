"""Corpus pipeline: the stages, each from a table of documents to the next one's, and the run of all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from docquery.llm import decontamination, jaccard, packing, quality, secrets
from docquery.llm.common import quoted, written

#: Columns of the pipeline's own while a stage works.
_SCORE, _ID = "__score", "__id"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier gives a score of 0.5 or more."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, column=_SCORE).where(F.col(_SCORE) >= 0.5).select(*[quoted(c) for c in docs.columns])


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents that links connect (five words, 0.8 or more), the row of the least doc_id.

    Rows that repeat a doc_id with different texts are documents of their own, which link or do not; of rows that repeat
    both one stays. Rows without a doc_id link with nothing and stay.
    """
    row = F.when(quoted("doc_id").isNotNull(), F.struct(quoted("doc_id").alias("doc_id"), F.unhex(F.md5(F.coalesce(quoted("text"), F.lit("")).cast("binary"))).alias("text")))
    classes = jaccard.components(docs.select(row.alias(_ID), "text"), key=_ID, size=5, num=80, den=100).where(F.col(_ID) == F.col("component_id")).select(_ID).distinct()
    kept = docs.withColumn(_ID, row).join(classes, _ID)
    first = F.row_number().over(Window.partitionBy(_ID).orderBy(*[c for c in docs.columns if c != "text"]))
    kept = kept.withColumn(_SCORE, first).where(F.col(_SCORE) == 1).select(*[quoted(c) for c in docs.columns])
    return kept.unionByName(docs.where(quoted("doc_id").isNull()))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of a benchmark item occurs."""
    found = decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("n_hit = 0").select(*[quoted(c) for c in docs.columns])


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in them replaced by a mark; n_chars follows."""
    text = secrets.redacted(quoted("text"), F.col("spans"))
    found = secrets.scan(docs).withColumn("text", text)
    return found.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(quoted("n_chars"))).select(*[quoted(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", good_quality),
    ("ngram_jaccard_join", one_of_near_copies),
    ("benchmark_decontamination", decontaminated),
    ("secret_scans", without_secrets),
    ("best_fit_packing", packed),
]

#: A learned classifier and a tokenizer decide the rows, which SQL cannot express: tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over documents, each result written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
