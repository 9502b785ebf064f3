"""What the endpoints of a service ask for: pages of lists, one day's rows, and a summary with its note."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed texts of the note on performance.
OUT_OF_SAMPLE = "Walk-forward out-of-sample, net of modeled costs."
BEHIND = "UNDERPERFORMS {} buy-and-hold on this window."
SURVIVORS = "Survivorship bias present (no point-in-time constituents file)."


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int = 500, **equal) -> DataFrame:
    """A page of a list: rows whose columns equal what is asked for (None asks for nothing), in order; `most` bounds a page."""
    if not 0 < limit <= most or offset < 0:
        raise ValueError(f"a page has 1 to {most} rows, and starts at 0 or later")
    for column, value in equal.items():
        rows = rows if value is None else rows.where(F.col(column) == F.lit(value))
    return rows.orderBy(*order).offset(offset).limit(limit)


def of_day(rows: DataFrame, date: str | None = None) -> DataFrame:
    """The rows of a date, or of the last date there is."""
    if date is not None:
        return rows.where(F.col("date") == F.lit(date).cast("date"))
    return rows.join(F.broadcast(rows.agg(F.max("date").alias("date"))), "date")  # one row


def performance(summary: DataFrame, benchmark: str, point_in_time: bool) -> DataFrame:
    """A strategy's summary (ann_return, and benchmark's ann_return as `benchmark_return`) with the note that it must carry."""
    behind = F.when(F.col("ann_return") < F.col("benchmark_return"), F.lit(BEHIND.format(benchmark)))
    parts = [F.lit(OUT_OF_SAMPLE), behind, F.lit(None if point_in_time else SURVIVORS).cast("string")]
    return summary.withColumn("note", F.concat_ws(" ", *parts))
