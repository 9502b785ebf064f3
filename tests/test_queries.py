"""Every query against its SQL on the smallest tables, and known values of single operators."""

import datetime
import decimal
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paneltide.functions import text as X
from paneltide.operators import fundamentals as N
from paneltide.operators import iterative as I
from paneltide.operators import joins as J
from paneltide.operators import tables as K
from paneltide.operators import windows as W
from paneltide.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
here = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.strftime("%Y-%m-%d %H:%M:%S")
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, "n" if isinstance(x, (int, float)) else str(type(x)), x if x is not None else 0) for x in r))


def close(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, (int, float)) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1.1e-5))


@here
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = ordered([tuple(plain(r[c]) for c in columns) for r in df.collect()])
    found = duck.execute(catalog.ORACLE_SQL[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == columns
    want = ordered([tuple(plain(r[at.index(c)]) for c in columns) for r in found.fetchall()])
    assert len(got) == len(want)
    assert all(close(x, y) for a, b in zip(got, want) for x, y in zip(a, b))


def bars(spark, closes, ticker="AAA", start="2024-01-02"):
    days = pd.bdate_range(start, periods=len(closes)).date
    rows = [(d, ticker, c, c, c, float(c), 1e6) for d, c in zip(days, map(float, closes))]
    return spark.createDataFrame(rows, "date date, ticker string, open double, high double, low double, close double, volume double")


def test_known_returns_and_no_bleed(spark):
    panel = bars(spark, [100, 110, 99, 99, 99, 99]).unionByName(bars(spark, [10, 20], "BBB"))
    rows = {(r.ticker, i): r for t in ("AAA", "BBB") for i, r in enumerate(W.reversal(panel).where(F.col("ticker") == t).orderBy("date").collect())}
    assert rows["AAA", 0].rev_ret_1d is None and rows["BBB", 0].rev_ret_1d is None
    assert rows["AAA", 1].rev_ret_1d == pytest.approx(0.10) and rows["AAA", 5].rev_ret_5d == pytest.approx(-0.01)
    assert rows["BBB", 1].rev_ret_1d == pytest.approx(1.0)


def test_features_do_not_see_the_future(spark):
    rng = np.random.default_rng(7)
    prices = 100 * np.cumprod(1 + rng.normal(0, 0.01, 120))
    whole = {r.date: r for r in W.trend(bars(spark, prices)).collect()}
    part = W.trend(bars(spark, prices[:90])).collect()
    assert all(r.trend_vol21_ann == whole[r.date].trend_vol21_ann for r in part)


def test_rank_share_averages_ties(spark):
    df = spark.createDataFrame([("d", 1.0), ("d", 2.0), ("d", 2.0), ("d", None)], "k string, x double")
    got = [r.s for r in df.select(W.pct_rank("x", "k").alias("s")).collect()]
    assert sorted(x for x in got if x is not None) == pytest.approx([1 / 3, 2.5 / 3, 2.5 / 3]) and got.count(None) == 1


def test_as_of_is_strict(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1)], "ticker string, at int")
    right = spark.createDataFrame([("a", 2, 10.0), ("a", 2, 11.0)], "ticker string, filed int, val double")
    strict = {(r.ticker, r["at"]): r.val for r in J.as_of(left, right, "ticker", "at", "filed", ["val"], ties=["val"]).collect()}
    assert strict == {("a", 1): None, ("a", 2): None, ("a", 3): 11.0, ("b", 1): None}
    loose = {(r.ticker, r["at"]): r.val for r in J.as_of(left, right, "ticker", "at", "filed", ["val"], ties=["val"], strict=False).collect()}
    assert loose["a", 2] == 11.0 and loose["a", 1] is None


def test_membership_windows(spark):
    rows = spark.createDataFrame([(t, d) for t in ("AAA", "BBB", "SPY") for d in ("2019-06-01", "2020-06-01", "2022-06-01")], "ticker string, d string").select("ticker", F.to_date("d").alias("date"))
    spans = spark.createDataFrame([("AAA", "2020-01-01", "2021-12-31"), ("BBB", "2019-01-01", None)], "ticker string, s string, e string").select("ticker", F.to_date("s").alias("start"), F.to_date("e").alias("end"))
    got = {(r.ticker, r.date.year) for r in J.members(rows, spans).collect()}
    assert got == {("AAA", 2020), *((t, y) for t in ("BBB", "SPY") for y in (2019, 2020, 2022))}


def test_inserts_are_idempotent(spark):
    old = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 9), ("b", 3), ("b", 2)], "k string, v int")
    once = K.insert_ignore(old, new, ["k"], "v")
    twice = K.insert_ignore(once, new, ["k"], "v")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("a", 1), ("b", 2)]


def test_spanning_tree_and_paths():
    line = np.array([[0.0], [1.0], [3.0]])
    assert I.tree_length(line) == pytest.approx(math.sqrt(1 + 4))
    cost = np.array([[0, 1], [1, 0.9], [0, 1], [5, 0], [5, 0.0]])
    assert I.two_state_path(cost[:, 1] - cost[:, 0], 1.0).tolist() == [0, 0, 0, 1, 1]


def test_reply_scores(spark):
    cases = {'ok {"score": 130}': 100.0, "about 42 of 100": 42.0, "none": 50.0, None: 50.0, "in 2024 I say 85": 85.0, '{"score": 71.9}': 71.0, '{"risk": 3}': 50.0, "{bad 7}": 7.0, '{"score": -4}': 0.0}
    rows = spark.createDataFrame([(x,) for x in cases], "x string")
    assert {r.x: r.s for r in rows.select("x", X.score_reply(F.col("x")).alias("s")).collect()} == cases


@here
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL) - {"b07_walk_forward_ranker", "b08_walk_forward_classifier"}))
def test_other_queries_run(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    keys = [c for c in ("variant", "ticker", "date") if c in df.columns]
    assert not keys or len({tuple(r[c] for c in keys) for r in rows}) == len(rows)
    assert all(v is None or not isinstance(v, float) or math.isfinite(v) for r in rows for v in r)


@here
def test_regimes_begin_after_the_whole_window(spark):
    big = SF.replace("0.001", "0.1")
    if not os.path.isdir(big):
        pytest.skip("no longer panel")
    assert catalog.QUERIES["b04_jump_regimes"](spark, big).count() <= 2499 - 1008


def dated(spark, rows, schema, *dates):
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.to_date(c) for c in dates})


def company_facts():
    """Thirteen quarters of a company; its cash flow is reported as running totals of the year."""
    ends = [d.date() for d in pd.date_range("2020-03-31", periods=13, freq="QE")]
    rows, total = [], 0.0
    for i, end in enumerate(ends):
        filed, start = end + datetime.timedelta(40), (pd.Timestamp(end) - pd.offsets.QuarterBegin(startingMonth=1)).date()
        total = 120.0 + i + (0.0 if end.month == 3 else total)
        put = lambda tag, val, start=None: rows.append(("AAA", tag, start and str(start), str(end), str(filed), float(val)))  # noqa: E731, B023
        put("NetIncomeLoss", 100 + i, start)
        put("Revenues", 1000 + 10 * i, start)
        put("OperatingCash", total, datetime.date(end.year, 1, 1))
        put("Assets", 10000 + 100 * i)
        put("StockholdersEquity", 5000 + 50 * i)
        if end.month == 12:
            put("EntityPublicFloat", 50000)
    return rows


FACTS = "ticker string, tag string, start string, end string, filed string, val double"


def test_quarters_by_three_ways(spark):
    facts = dated(spark, company_facts(), FACTS, "start", "end", "filed")
    cash = [r.val for r in N.quarterly(facts, ["OperatingCash"]).orderBy("end").collect()]
    assert cash == [120.0 + i for i in range(13)]
    last = N.trailing_year(N.quarterly(facts, ["NetIncomeLoss"])).orderBy(F.desc("end")).first()
    assert (last.ttm, str(last.filed)) == (sum(100 + i for i in range(9, 13)), "2023-05-10")
    holed = N.trailing_year(N.quarterly(facts.where("end <> '2022-06-30'"), ["NetIncomeLoss"]))
    assert holed.where("end BETWEEN '2022-06-30' AND '2023-03-31'").count() == 0
    days = dated(spark, [("AAA", "2023-05-10"), ("AAA", "2023-05-11")], "ticker string, date string", "date")
    before, after = N.ratios(days, facts).orderBy("date").collect()
    assert after.fund_ey == pytest.approx(442 / 50000) and before.fund_ey == pytest.approx(sum(100 + i for i in range(8, 12)) / 50000)
    assert after.fund_cfo_yield == pytest.approx(sum(120 + i for i in range(9, 13)) / 50000)
    assert after.fund_accruals == pytest.approx((sum(100 + i for i in range(9, 13)) - sum(120 + i for i in range(9, 13))) / 11200)


def test_growth_against_any_base(spark):
    rows = [("A", f"20{20 + i // 4}-{3 * (i % 4) + 3:02}-28", "2024-01-01", v) for i, v in enumerate([-2.0, 4.0, 0.0, 1.0, 1.0, 2.0, 3.0, 4.0])]
    series = dated(spark, rows, "ticker string, end string, filed string, v double", "end", "filed")
    assert [r.yoy for r in N.year_on_year(series, "v").orderBy("end").collect()] == [-1.5, -0.5, 3.0]
    assert [r.yoy for r in N.year_on_year(series, "v", True).orderBy("end").collect()] == [1.5, -0.5, 3.0]


def test_series_with_splits_and_gaps(spark):
    rng, rows = np.random.default_rng(1), []
    plain = 100 * np.cumprod(1 + rng.normal(0, 0.01, 300))
    halved, fell, wild, third = plain.copy(), plain.copy(), plain.copy(), plain.copy()
    halved[150:] = halved[150:] / halved[150] * halved[149] * 0.5
    fell[150:] = fell[150:] / fell[150] * fell[149] * 0.53
    third[150:] = third[150:] / third[150] * third[149] * 2.02 / 3
    for k in range(20, 200, 20):
        wild[k:] *= 1.45 if k % 40 else 0.56
    gone = halved.copy()
    for name, close in (("plain", plain), ("halved", halved), ("fell", fell), ("wild", wild), ("gone", gone), ("short", plain[:200])):
        for i, c in enumerate(close):
            rows.append((name, str(datetime.date(2020, 1, 1) + datetime.timedelta(i + (700 if name == "gone" and i >= 150 else 0))), float(c)))
    panel = dated(spark, rows, "ticker string, date string, close double", "date").selectExpr("*", "close AS open", "close AS high", "close AS low")
    ok = {r.ticker: r.ok for r in K.series_checks(panel).collect()}
    assert ok == {"plain": True, "halved": False, "fell": True, "wild": False, "gone": True, "short": False}
    with pytest.raises(ValueError):
        K.surviving(K.series_checks(panel), 0.9)


@pytest.mark.parametrize("ratio,split", [(2 / 3, True), (0.75, True), (0.8, True), (1.5, True), (1 / 7, False), (15.0, False), (0.53, False), (-1.0, False)])
def test_split_ratios(spark, ratio, split):
    assert spark.range(1).select(X.looks_like_split(F.lit(ratio))).first()[0] is split


def test_recursive_means_follow_pandas(spark):
    close = 100 * np.cumprod(1 + np.random.default_rng(8).normal(0, 0.02, 700))
    got = [r.hist for r in W.macd(bars(spark, close, "T0")).orderBy("date").collect()]
    s = pd.Series(close)
    line = s.ewm(span=12, adjust=False).mean() - s.ewm(span=26, adjust=False).mean()
    assert got == pytest.approx((line - line.ewm(span=9, adjust=False).mean()).tolist(), abs=1e-9)
    for halflife in (3.0, 60.0):
        smooth = [r.smooth for r in W.smoothed(bars(spark, close, "T0"), "close", halflife).orderBy("date").collect()]
        assert smooth == pytest.approx(s.ewm(halflife=halflife).mean().tolist(), rel=1e-9)


@here
def test_cooldown_by_force(spark):
    got = sorted((r.user_id, r.ts) for r in catalog.QUERIES["t05_cooldown_stream"](spark, SF).collect())
    want, last = [], {}
    for r in sorted(spark.read.parquet(f"{SF}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value").collect(), key=lambda r: r.ts):
        if r.value >= 90 and (r.user_id not in last or r.ts - last[r.user_id] >= datetime.timedelta(minutes=90)):
            last[r.user_id] = r.ts
            want.append((r.user_id, r.ts))
    assert got == sorted(want) and got


def test_table_hash_sees_values_not_order(spark):
    rows = [("a", 1.0), ("b", 2.0), ("b", 2.0)]
    digest = lambda r: K.table_hash(spark.createDataFrame(r, "k string, v double"), ["k", "v"]).first()
    assert digest(rows) == digest(rows[::-1]) != digest([*rows[:2], ("b", 2.1)]) and digest(rows) != digest(rows[:2])
