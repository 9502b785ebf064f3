"""Correlations of all pairs of keys by blocks: sums of products as matrices, never as joined rows.

Keys are dealt into blocks. A block is one row, stored once; pairs of blocks meet in a cross join, so a
task holds two blocks and no copy of a block is shuffled. Sums over common times are products of one
block's matrix with the other's. Of the neighbours of a key only the nearest of each pair of blocks go
on, and they are merged at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paneltide.sources.shared import shared_path

#: Keys of a block, times whose products are made at once, and keys of the left block whose pairs make a batch of rows.
BLOCK, TIMES, SLICE = 1024, 1024, 128


def correlated(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of common times and correlation (NaN where undefined) of each column of x with each of y; NaN is missing."""
    n, sx, sy, sxy, sxx, syy = (np.zeros((x.shape[1], y.shape[1])) for _ in range(6))
    for k in range(0, len(x), TIMES):
        a, b = x[k : k + TIMES], y[k : k + TIMES]
        here, there = ~np.isnan(a), ~np.isnan(b)
        n += here.T.astype(np.float32) @ there.astype(np.float32)  # whole numbers: exact
        here, there = here.astype(float), there.astype(float)
        a, b = np.nan_to_num(a), np.nan_to_num(b)
        for total, left, right in ((sx, a, there), (sy, here, b), (sxy, a, b), (sxx, a * a, there), (syy, here, b * b)):
            total += left.T @ right
    with np.errstate(invalid="ignore", divide="ignore"):
        vx, vy = sxx - sx * sx / n, syy - sy * sy / n
        flat = (vx <= 1e-13 * sxx) | (vy <= 1e-13 * syy)  # does not vary, but for what sums lose
        return n, np.where(flat, np.nan, (sxy - sx * sy / n) / np.sqrt(vx * vy))


def by_blocks(df: DataFrame, key: str, on: str, value: str, pick: Callable, schema: str, block: int = BLOCK) -> DataFrame:
    """pick(keys, other keys, n, correlation, whether both are one block) -> batches, for each pair of blocks."""
    spark = df.sparkSession
    rows = df.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(on).alias("t"), F.col(value).cast("double").alias("v"))
    held = shared_path(spark, "values")
    rows.write.parquet(held)  # counted and dealt from what is stored: df is worked out once
    rows = spark.read.schema(rows.schema).parquet(held)
    blocks = max(1, -(-rows.agg(F.count_distinct("k")).first()[0] // block))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int"))

    def packed(group: pa.Table) -> pa.Table:
        names, at = np.unique(group["k"].to_numpy().astype(str), return_inverse=True)
        lists = [names.tolist()], [at.astype(np.int32)], [group["t"].combine_chunks()], [group["v"].to_numpy()]
        kinds = pa.string(), pa.int32(), group["t"].type, pa.float64()
        columns = [pa.array([group["block"][0].as_py()], pa.int32()), *(pa.array(x, pa.list_(kind)) for x, kind in zip(lists, kinds))]
        return pa.Table.from_arrays(columns, ["block", "names", "at", "times", "values"])

    layout = f"block int, names array<string>, at array<int>, times array<{rows.schema['t'].dataType.simpleString()}>, values array<double>"
    path = shared_path(spark, "blocks")
    dealt.groupBy("block").applyInArrow(packed, layout).write.parquet(path)
    each = spark.read.schema(layout).parquet(path).repartitionByRange(blocks, "block")
    left, right = (each.select(*(F.col(c).alias(side + c) for c in each.columns)) for side in ("l_", "r_"))
    met = left.join(right, F.col("l_block") <= F.col("r_block"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {c: batch.column(i)[row] for i, c in enumerate(batch.schema.names)}
                i, j = one["l_block"].as_py(), one["r_block"].as_py()
                sides = [tuple(one[side + c].values.to_numpy(zero_copy_only=False) for c in ("names", "at", "times", "values")) for side in ("l_", "r_")]
                times = np.unique(np.concatenate([side[2] for side in sides]))
                tables = []
                for names, at, seen, values in sides:
                    table = np.full((len(times), len(names)), np.nan)
                    table[np.searchsorted(times, seen), at] = values
                    tables.append(table)
                a, b = (side[0].astype(str) for side in sides)
                yield from pick(a, b, *correlated(*tables), i == j)

    return met.mapInArrow(pairs, schema)


def pair_correlations(df: DataFrame, key: str, on: str, value: str, least: int, block: int = BLOCK) -> DataFrame:
    """a < b with the number of times they share (at least `least`) and their correlation; NULL where one does not vary."""

    def pick(a, b, n, corr, same):
        for k in range(0, len(a), SLICE):
            many, part = n[k : k + SLICE], corr[k : k + SLICE]
            row, column = np.nonzero((many >= least) & (np.arange(len(b)) > np.arange(k, k + len(many))[:, None] if same else True))
            left, right, value = a[k + row], b[column], part[row, column]
            low = left < right
            yield pa.RecordBatch.from_arrays([
                pa.array(np.where(low, left, right), pa.string()), pa.array(np.where(low, right, left), pa.string()),
                pa.array(many[row, column].astype(np.int64)), pa.array(value, mask=np.isnan(value)),
            ], ["a", "b", "n", "corr"])

    return by_blocks(df, key, on, value, pick, "a string, b string, n long, corr double", block)


def nearest(df: DataFrame, key: str, on: str, value: str, k: int, least: int, digits: int = 6, block: int = BLOCK) -> DataFrame:
    """a, b, corr and place of the k keys that correlate most with each; equal ones (rounded) in order of name, undefined last."""

    def pick(a, b, n, corr, same):
        value = np.where(n >= least, np.where(np.isnan(corr), -2.0, np.round(corr, digits)), -9.0)
        for names, others, table in [(a, b, value)] + ([] if same else [(b, a, value.T)]):
            table = table.copy()
            if same:
                np.fill_diagonal(table, -9.0)
            most = min(k, table.shape[1])
            # All that reach the k-th value, then the first k of them: columns are in order of name.
            floor = np.partition(table, table.shape[1] - most, axis=1)[:, table.shape[1] - most]
            row, column = np.nonzero((table >= floor[:, None]) & (table > -9.0))
            got = table[row, column]
            order = np.lexsort((column, -got, row))
            row, column, got = row[order], column[order], got[order]
            first = np.searchsorted(row, row)
            kept = np.arange(len(row)) - first < k
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[row[kept]], pa.string()), pa.array(others[column[kept]], pa.string()), pa.array(got[kept])], ["a", "b", "corr"]
            )

    made = by_blocks(df, key, on, value, pick, "a string, b string, corr double", block)
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.col("corr").desc(), "b"))
    return made.withColumn("place", place.cast("long")).where(F.col("place") <= k).withColumn("corr", F.when(F.col("corr") > -2, F.col("corr")))
