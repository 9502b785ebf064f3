"""Training-data pipeline: five stages from documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet and
hands what it reads back to the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paneltide.llm import lang_id, near_dup, packing, secret_scan
from paneltide.llm.common import crc_of_id, documents, written
from paneltide.llm.queries import quality_model
from paneltide.llm.quality import keep_good

#: Rows of an Arrow batch. Texts are long, and executors hold a batch several times on its way to Python.
BATCH_ROWS = 1000
#: Share of a text, weighted by confidence, that must be in one language. A text in even parts of
#: all four languages would still pass with 0.25; below are those of no language that was learnt.
LEAST_IDENTIFIED = 0.2


def small_batches(spark: SparkSession) -> None:
    """A stage is evaluated after it returns, so this stays set for the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a known language; those without a letter, or of no known one, go."""
    small_batches(spark)
    return lang_id.keep_identified(docs, lang_id.train(docs.where(crc_of_id() % 5 != 0)), LEAST_IDENTIFIED)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier scores at its threshold or above."""
    small_batches(spark)
    return keep_good(docs, quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the lowest id of each class of near-duplicates."""
    small_batches(spark)
    return near_dup.keep_first(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; no document goes."""
    small_batches(spark)
    return secret_scan.redact(docs, length_col="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenises and packs what is left into sequences."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("language id", language),
    ("quality classifier", good_quality),
    ("near-duplicates", distinct_documents),
    ("secret scan", without_secrets),
    ("best-fit packing", packed),
]

#: Learnt models and signatures: not to be said in SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
