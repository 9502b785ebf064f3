"""Event streams: windows with watermarks, cooldowns, change-only alerts, late and repeated rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet", schema: str = SCHEMA) -> DataFrame:
    """A folder of Parquet files as a stream, with a timestamp that watermarks accept."""
    raw = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts and sums per type in tumbling or sliding windows; the same plan for batch and stream."""
    rows = events.withWatermark("ts", late) if late else events
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    made = rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return made.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    made = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return made.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def first_seen(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Repeated rows of a key inside the watermark go."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


FIRED = "user_id long, ts timestamp, value double"


def with_cooldown(events: DataFrame, threshold: float, minutes: int) -> DataFrame:
    """Rows at or over a threshold, one per key and cooldown (keyed state holds the last one fired)."""

    def fire(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        rows = pd.concat(list(batches)).sort_values("ts")
        out = []
        for r in rows.itertuples():
            if r.value >= threshold and (last is None or r.ts - last >= pd.Timedelta(minutes=minutes)):
                last = r.ts
                out.append((key[0], r.ts, r.value))
        if last is not None:
            state.update((int(last.value // 1000),))
        yield pd.DataFrame(out, columns=["user_id", "ts", "value"]).astype({"user_id": "int64", "value": "float64"})

    rows = events.select("user_id", "ts", "value")
    return rows.groupBy("user_id").applyInPandasWithState(fire, FIRED, "last long", "append", GroupStateTimeout.NoTimeout)


def changes_only(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before of their key (batch form of change-only alerts)."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_before", F.lag(value).over(w)).where(~F.col(value).eqNullSafe(F.col("_before"))).drop("_before")


def decision_alerts(rows: DataFrame, key: str, order: list[str], action: str, notify_all: bool = False) -> DataFrame:
    """Decisions to BUY or SELL that differ from the one before of their key; all of them with notify_all.

    The one before may be any action: a BUY after a HOLD is told again.
    """
    before = F.lag(action).over(Window.partitionBy(key).orderBy(*order))
    told = F.col(action).isin("BUY", "SELL")
    fires = told if notify_all else told & ~F.col(action).eqNullSafe(before)
    return rows.withColumn("_fires", fires).where("_fires").drop("_fires")


def run_once(stream: DataFrame, checkpoint: str, path: str, mode: str = "append") -> None:
    """Works off what is there and stops; progress is kept in the checkpoint."""
    stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start().awaitTermination()


def merge_batches(stream: DataFrame, checkpoint: str, merge) -> None:
    """merge(batch, epoch) for each micro-batch: upserts, or inserts that ignore known keys."""
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
