"""Stored tables that micro-batches are merged into: only partitions that a batch changes are read and written.

Merges are idempotent: a batch that is run again, whole or after a part of its partitions was written,
leaves the table as one run does. The merged rows are written beside the table first, so no task reads
what another replaces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from paneltide.sources.shared import shared_path


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The stored table; empty before the first merge."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def _first(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", place).where("_n = 1").drop("_n")


def _partitions(rows: DataFrame, by: str) -> list:
    """The partitions that a micro-batch touches; the trigger bounds them."""
    return [r[0] for r in rows.select(by).distinct().collect()]


def _rewrite(rows: DataFrame, path: str, by: str) -> None:
    beside = shared_path(rows.sparkSession, "merge")
    rows.write.parquet(beside)
    merged = rows.sparkSession.read.schema(rows.schema).parquet(beside)
    merged.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def insert_missing(batch: DataFrame, path: str, keys: Sequence[str], by: str, order: Sequence[str]) -> int:
    """Adds rows whose key the table lacks; of several in the batch, the first in order. Known rows stay as they are.

    keys hold the partition column, as far as a key never moves to another partition. Returns how many partitions were written.
    """
    spark, new = batch.sparkSession, _first(batch, keys, [F.col(c) for c in order])
    table = read(spark, path, batch.schema)
    known = table.where(F.col(by).isin(_partitions(batch, by))).select(*keys)
    fresh = new.join(known, list(keys), "left_anti")
    beside = shared_path(spark, "fresh")
    fresh.write.parquet(beside)
    fresh = spark.read.schema(batch.schema).parquet(beside)
    changed = _partitions(fresh, by)
    if changed:
        _rewrite(table.where(F.col(by).isin(changed)).unionByName(fresh), path, by)
    return len(changed)


def upsert(batch: DataFrame, path: str, keys: Sequence[str], by: str, order: Sequence[str]) -> int:
    """Keeps the last row of each key in order, of the table and the batch. Returns how many partitions were written.

    A partition is written only where a row of the batch is newer than what is stored.
    """
    spark = batch.sparkSession
    newest = _first(batch, keys, [F.col(c).desc() for c in order])
    table = read(spark, path, batch.schema)
    place = F.struct(*order)
    known = table.where(F.col(by).isin(_partitions(batch, by))).groupBy(*keys).agg(F.max(place).alias("_known"))
    later = newest.join(known, list(keys), "left").where(F.col("_known").isNull() | (place > F.col("_known"))).select(*batch.columns)
    beside = shared_path(spark, "later")
    later.write.parquet(beside)
    later = spark.read.schema(batch.schema).parquet(beside)
    changed = _partitions(later, by)
    if changed:
        both = table.where(F.col(by).isin(changed)).unionByName(later)
        _rewrite(_first(both, keys, [F.col(c).desc() for c in order]), path, by)
    return len(changed)
