"""Streams in several micro-batches, with rows that come late or again, against what one batch gives."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from paneltide.streaming import events as E
from paneltide.streaming import keyed as KS
from paneltide.streaming import stored as ST

DAY0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "event_id long, user_id long, ts timestamp, value double, payload string"


def at(minutes):
    return DAY0 + dt.timedelta(minutes=minutes)


def arrive(spark, folder, batches):
    """One file per micro-batch, in order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        for name in os.listdir(folder):
            path = os.path.join(folder, name)
            if name.endswith(".parquet") and os.path.getmtime(path) > 1e9 + 1000 * (k + 1):
                os.utime(path, (1e9 + 1000 * k,) * 2)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def left_over(spark, place, variable):
    """Rows of a state variable that are left after a run."""
    return spark.read.format("statestore").option("stateVarName", variable).load(place).count()


def greedy(rows, threshold, minutes):
    last, out = {}, []
    for _, user, ts, value, _ in sorted(rows, key=lambda r: (r[2], r[3])):
        if value >= threshold and (user not in last or ts - last[user] >= dt.timedelta(minutes=minutes)):
            last[user] = ts
            out.append((user, ts, value))
    return sorted(out)


def test_cooldown_puts_late_rows_in_order_and_forgets_idle_keys(spark, tmp_path):
    batches = [
        [(1, 7, at(0), 95.0, ""), (2, 7, at(100), 99.0, ""), (3, 8, at(50), 10.0, "")],
        [(4, 7, at(70), 97.0, ""), (5, 8, at(90), 96.0, ""), (6, 7, at(130), 91.0, "")],  # the first is late, and takes the place of event 2
        [(7, 8, at(95), 99.0, ""), (8, 7, at(165), 93.0, ""), (9, 9, at(6000), 1.0, "")],
    ]
    stream = arrive(spark, str(tmp_path / "in"), batches)
    E.run_once(KS.with_cooldown(stream, 90.0, 60, "2 hours"), str(tmp_path / "progress"), str(tmp_path / "out"))
    rows = spark.read.schema(KS.FIRED).parquet(str(tmp_path / "out")).select("user_id", F.unix_micros("ts").alias("t"), "value").collect()
    micros = lambda ts: int(ts.timestamp() * 1e6)
    assert sorted(map(tuple, rows)) == [(u, micros(ts), v) for u, ts, v in greedy(sum(batches, []), 90.0, 60)]
    assert [(u, v) for u, _, v in sorted(map(tuple, rows))] == [(7, 95.0), (7, 97.0), (7, 91.0), (8, 96.0)]
    assert left_over(spark, str(tmp_path / "progress"), "waiting") == left_over(spark, str(tmp_path / "progress"), "last") == 0


def test_revisions_of_a_session_across_batches(spark, tmp_path):
    batches = [
        [(1, 7, at(0), 0.0, "BUY"), (2, 7, at(10), 0.0, "BUY"), (3, 7, at(2000), 0.0, "HOLD")],
        [(4, 7, at(30), 0.0, "SELL"), (5, 7, at(2100), 0.0, "HOLD"), (6, 8, at(40), 0.0, "BUY")],
        [(1, 7, at(0), 0.0, "SELL"), (7, 7, at(50), 0.0, "BUY"), (8, 9, at(90 * 1440), 0.0, "BUY")],
    ]
    stream = arrive(spark, str(tmp_path / "in"), batches)
    E.run_once(KS.revisions(stream, "payload", "3 days", 30), str(tmp_path / "progress"), str(tmp_path / "out"))
    rows = spark.read.schema(KS.REVISIONS).parquet(str(tmp_path / "out"))
    got = sorted((r.user_id, str(r.session), r.revision, r.event_id, r.payload) for r in rows.collect())
    assert got == [
        (7, "2024-01-01", 0, 1, "BUY"), (7, "2024-01-01", 1, 4, "SELL"), (7, "2024-01-01", 2, 7, "BUY"), (7, "2024-01-02", 0, 3, "HOLD"),
        (8, "2024-01-01", 0, 6, "BUY"), (9, "2024-03-31", 0, 8, "BUY"),
    ]
    kept = spark.read.format("statestore").option("stateVarName", "known").load(str(tmp_path / "progress"))
    assert [r.key.user_id for r in kept.select("key").collect()] == [9]  # the others' sessions ended over 30 days ago


ROWS = "user_id long, day date, event_id long, value double"


def rows(spark, *values):
    return spark.createDataFrame([(u, dt.date(2024, 1, d), e, v) for u, d, e, v in values], ROWS)


def table(spark, path):
    return sorted((r.user_id, r.day.day, r.event_id, r.value) for r in ST.read(spark, path, spark.createDataFrame([], ROWS).schema).collect())


def files(path):
    found = {}
    for folder, _, names in os.walk(path):
        for name in names:
            if name.endswith(".parquet"):
                with open(os.path.join(folder, name), "rb") as f:
                    found[os.path.relpath(os.path.join(folder, name), path)] = f.read()
    return found


def test_insert_missing_reads_and_writes_only_changed_partitions(spark, tmp_path):
    path, keys = str(tmp_path / "t"), ["user_id", "day"]
    insert = lambda batch: ST.insert_missing(batch, path, keys, "day", ["event_id"])
    assert insert(rows(spark, (1, 1, 10, 1.0), (1, 1, 11, 2.0), (2, 2, 12, 3.0), (1, 3, 13, 4.0))) == 3
    before = files(path)
    late = rows(spark, (1, 1, 9, 9.0), (3, 2, 20, 5.0))  # a known key that comes late and loses, and a new one
    assert insert(late) == 1
    assert table(spark, path) == [(1, 1, 10, 1.0), (1, 3, 13, 4.0), (2, 2, 12, 3.0), (3, 2, 20, 5.0)]
    after = files(path)
    same = {k: v for k, v in before.items() if "day=2024-01-02" not in k}
    assert {k: v for k, v in after.items() if "day=2024-01-02" not in k} == same
    assert insert(late) == 0 and files(path) == after  # run again


def test_upsert_keeps_the_newest(spark, tmp_path):
    path, keys = str(tmp_path / "t"), ["user_id", "day"]
    upsert = lambda batch: ST.upsert(batch, path, keys, "day", ["event_id"])
    assert upsert(rows(spark, (1, 1, 10, 1.0), (2, 1, 11, 2.0), (1, 2, 12, 3.0))) == 2
    before = files(path)
    batch = rows(spark, (1, 1, 9, 9.0), (2, 1, 15, 7.0), (2, 1, 14, 6.0), (1, 2, 12, 3.0))
    assert upsert(batch) == 1
    assert table(spark, path) == [(1, 1, 10, 1.0), (1, 2, 12, 3.0), (2, 1, 15, 7.0)]
    after = files(path)
    assert {k: v for k, v in after.items() if "02" in k.split("/")[0][-2:]} == {k: v for k, v in before.items() if "02" in k.split("/")[0][-2:]}
    assert upsert(batch) == 0 and files(path) == after


@pytest.mark.parametrize("merge", [ST.insert_missing, ST.upsert])
def test_an_empty_batch_changes_nothing(spark, tmp_path, merge):
    path = str(tmp_path / "t")
    assert merge(spark.createDataFrame([], ROWS), path, ["user_id", "day"], "day", ["event_id"]) == 0
    assert not os.path.exists(path)
