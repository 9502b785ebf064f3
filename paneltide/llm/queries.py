"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneltide.llm import (
    chat_format, filter_audit, flac, lang_id, near_dup, packing, piece_codec, quality, secret_scan, suffix_dedup, token_count,
    vector_codes, winnow,
)
from paneltide.llm.common import crc_of_id, documents


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = lang_id.train(docs.where(crc_of_id() % 5 != 0))
    return lang_id.predict(docs, model).select("doc_id", (crc_of_id() % 5 == 0).alias("held_out"), "lang_pred", "score", "spans")


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(documents(spark, sf_dir))


def op3_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.media_digests(documents(spark, sf_dir))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"), spark)


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model:
    """Learnt outside of fold 2; the share of good rows comes from the labels there."""
    known = labels.where((crc_of_id() % 4 != 2) & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    share = known.agg(F.avg("quality")).first()[0]
    prior = None if share is None else min(0.95, max(0.05, share))
    return quality.train(docs.where(crc_of_id() % 4 != 2), known.where("quality = 1").select("doc_id"), prior)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.predict(docs, model).select("doc_id", (crc_of_id() % 4 == 2).alias("held_out"), "score", "predicted")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(documents(spark, sf_dir))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.fingerprints(documents(spark, sf_dir))


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.round_trips(documents(spark, sf_dir))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, sf_dir))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_near_dup, op3_flac_media, op4_chat_format, op5_quality, op6_token_counts, op7_secret_scan,
    op8_best_fit_packing, op9_winnowing, op10_piece_codec, op11_suffix_dedup, op12_filter_audit, op13_vector_codes,
)}
ORACLE_SQL: dict[str, str] = {"op11_suffix_dedup": suffix_dedup.SQL, "op12_filter_audit": filter_audit.SQL, "op13_vector_codes": vector_codes.SQL}
