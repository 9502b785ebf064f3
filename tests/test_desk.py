"""Gates, sizing, tickets, families, pages and quantiles on small tables with known results."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paneltide.functions import text as X
from paneltide.operators import families as X1
from paneltide.operators import neighbours as N
from paneltide.operators import portfolios as P
from paneltide.operators import quantiles as Q
from paneltide.operators import tables as K
from paneltide.operators import templates as T
from paneltide.sources import documents as D
from paneltide.sources import files
from tests.test_strategies import made_panel


def day(d):
    return dt.date(2024, 1, d)


@pytest.fixture(scope="module")
def gated(spark):
    days = spark.createDataFrame([(day(d),) for d in (2, 3, 4, 5, 8)], "date date")
    earnings = spark.createDataFrame([("AAA", day(4)), ("BBB", day(8)), ("CCC", None)], "ticker string, earnings_date date")
    vix = spark.createDataFrame([(day(2), 20.0, 18.0), (day(3), 15.0, 18.0), (day(4), 0.0, 18.0)], "date date, vix double, vix3m double")
    states = spark.createDataFrame([(day(2), 1), (day(3), 0)], "date date, state int")
    equity = spark.createDataFrame([(day(2), 89.0, 100.0), (day(3), 91.0, 100.0), (day(8), 50.0, 0.0)], "date date, equity double, high_water_mark double")
    return days, earnings, vix, states, equity


def test_all_gates(spark, gated):
    rows = {r.date.day: r for r in P.decisions(*gated).collect()}
    assert {d: r.excluded for d, r in rows.items()} == {2: ["AAA"], 3: ["AAA"], 4: ["AAA", "BBB"], 5: ["BBB"], 8: ["BBB"]}
    assert {d: (r.exposure_scale, r.allow_new_entries) for d, r in rows.items()} == {2: (0.25, False), 3: (1.0, True), 4: (1.0, True), 5: (1.0, True), 8: (1.0, True)}
    assert rows[2].notes == [
        "earnings exclusion: ['AAA']", "VIX term structure inverted (VIX3M/VIX=0.90) — exposure halved, no new entries",
        "jump model: STRESS regime — exposure halved, no new entries", "drawdown circuit breaker: -11.0% from HWM — new entries halted",
    ]
    assert rows[4].notes[1:] == ["VIX gate INACTIVE (missing VIX/VIX3M data)", "jump-model gate INACTIVE (no regime state available)"]
    days, earnings, *others = gated
    none = P.decisions(days, earnings.limit(0), *others).collect()
    assert all(r.notes[0] == "earnings gate INACTIVE (no earnings calendar)" and r.excluded == [] for r in none)


@pytest.mark.parametrize("mode, want", [("off", [1.0, 1.0, 1.0]), ("tilt", [0.7, 0.4, 1.0]), ("gate", [1.0, 0.0, 1.0]), ("sized", [0.5, 0.0, 1.0])])
def test_sizing_modes(spark, mode, want):
    rows = spark.createDataFrame([(0, 0.7, 0.6, 0.7), (1, 0.4, 0.4, 0.7), (2, None, None, None)], "k int, prob double, prob_cal double, base_rate double")
    assert [r.size_mult for r in P.sized(rows, mode).orderBy("k").collect()] == pytest.approx(want)


def test_a_ticket_and_an_empty_day(spark):
    d = day(2)
    changes = spark.createDataFrame([(d, "AAA", 0.0, 0.5), (d, "BBB", 0.3, 0.1), (d, "CCC", 0.2, 0.2), (d, "DDD", 0.0, 0.0), (d, "EEE", 0.0, 0.1), (d, "FFF", 0.0, 0.0001)],
                                    "date date, ticker string, old double, new double")
    scores = spark.createDataFrame([(d, "AAA", 1.5), (d, "BBB", 0.25), (d, "CCC", 0.25), (d, "FFF", 3.0)], "date date, ticker string, score double")
    closes = spark.createDataFrame([(d, "AAA", 10.005), (d, "BBB", 1234.5), (d, "CCC", 7.0), (d, "DDD", 5.0), (d, "FFF", 900.0)], "date date, ticker string, close double")
    lines = K.ticket_lines(changes, scores, closes, 10_000.0)
    got = {r.ticker: (r["rank"], r.action, r.shares, str(r.limit_price)) for r in lines.collect()}
    assert got == {"AAA": (2, "buy", 499, "10.03"), "BBB": (4, "sell", 1, "1232.03"), "CCC": (4, "hold", 0, "6.99")}
    days = spark.createDataFrame([(d, ["note one", "note two"], True, "no model"), (day(3), [], False, "model")], "date date, notes array<string>, fallback_mode boolean, reason string")
    text = {r.date: r.markdown for r in K.whole_tickets(days, lines, 10_000.0, "paper", "Desk").collect()}
    assert text[d].split("\n")[:9] == ["# Desk — Trade Ticket for 2024-01-02", "", "Mode: **paper**  |  **FALLBACK MODE** — no model", "Sizing basis: $10,000 (paper)", "", "## Gates", "- note one", "- note two", ""]
    assert "| 2 | BUY | AAA | 499 | $10.03 | $10.01 | 50.0% | +1.5000 |" in text[d] and "| 4 | SELL | BBB | 1 | $1232.03 | $1,234.50 | 10.0% | +0.2500 |" in text[d]
    assert "| 4 | HOLD | CCC | — |" in text[d] and K.NO_TRADES in text[day(3)] and "## Gates" not in text[day(3)] and text[day(3)].endswith(K.DISCLAIMER + "\n")


def test_families_from_a_late_start_need_only_their_look_back(spark):
    panel = spark.createDataFrame(made_panel(420, ["AAA", "BBB"], 4))
    macro = spark.createDataFrame([(dt.date(2022, 1, 3), "VIX", 20.0)], "date date, series string, value double")
    names = ["reversal", "trend", "liquidity", "calendar"]
    since = "2023-07-03"
    whole = {(r.date, r.ticker): r for r in X1.build(panel, macro, names).where(F.col("date") >= since).collect()}
    late = X1.build(panel, macro, names, since=since).collect()
    assert len(late) == len(whole) > 50
    for r in late:
        for c in X1.feature_columns(spark.createDataFrame([], "date date")) or [c for c in r.asDict() if c not in ("date", "ticker")]:
            a, b = r[c], whole[r.date, r.ticker][c]
            assert (a is None and b is None) or a == pytest.approx(b, abs=1e-9), c
    with pytest.raises(ValueError, match="all tickers"):
        X1.build(panel, macro, ["spillover"], since=since)
    with pytest.raises(ValueError, match="unknown"):
        X1.build(panel, macro, ["none"])
    made = X1.build(panel, macro, ["signature", "turbulence"])
    assert made.count() == 840 and {"sig_tp_area", "turb_mahal"} <= set(made.columns)


def test_windows_of_quantiles_by_force(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=300), np.full(200, 0.25), rng.normal(size=100) * 1e6, [-1e300, 1e300]])
    part = rng.integers(0, 6, len(x))
    y = rng.integers(0, 2, len(x)).astype(float)
    rows = spark.createDataFrame(list(zip(part.tolist(), x.tolist(), y.tolist())), "part long, x double, y double")
    windows = {0: [0, 1, 2], 1: [2, 3], 2: [5], 3: [9]}
    spans = spark.createDataFrame([(b, p) for b, ps in windows.items() for p in ps], "block long, part long")
    shares = [0.0, 0.2, 0.5, 0.9, 1.0]
    got = {(r.block, r.q): r for r in Q.order_statistics(rows, spans, shares, cells=64).collect()}
    assert {b for b, _ in got} == {0, 1, 2}
    for (b, q), r in got.items():
        inside = np.isin(part, windows[b])
        cut = np.quantile(x[inside], shares[q])
        assert r.cut == pytest.approx(cut, rel=1e-12) and (r.n, r.y) == (inside.sum(), y[inside].sum())
        assert (r.n_upto, r.y_upto) == ((x[inside] <= r.cut).sum(), y[inside][x[inside] <= r.cut].sum())


def test_correlations_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(3)
    wide = pd.DataFrame(rng.normal(size=(90, 13)) + rng.normal(size=(90, 1)), columns=[f"K{i:02}" for i in range(13)])
    wide = wide.mask(rng.random(wide.shape) < 0.3)
    wide["K12"] = 1.0
    rows = spark.createDataFrame(wide.rename_axis("t").reset_index().melt("t", var_name="k", value_name="v").dropna())
    corr = wide.corr(min_periods=35)
    n = wide.notna().astype(int).T @ wide.notna().astype(int)
    for block in (4, 512):
        got = {(r.a, r.b): (r.n, r["corr"]) for r in N.pair_correlations(rows, "k", "t", "v", 35, block).collect()}
        assert got.keys() == {(a, b) for a in wide for b in wide if a < b and n.loc[a, b] >= 35}
        assert all(c == pytest.approx(corr.loc[p]) if c is not None else np.isnan(corr.loc[p]) for p, (_, c) in got.items())
        near = {(r.a, r.place): r.b for r in N.nearest(rows, "k", "t", "v", 3, 35, block=block).collect()}
        for a in wide.columns[:12]:
            order = sorted((b for b in wide if b != a and n.loc[a, b] >= 35), key=lambda b: (-(-2 if np.isnan(corr.loc[a, b]) else round(corr.loc[a, b], 6)), b))
            assert [near.get((a, k)) for k in (1, 2, 3)] == (order + [None] * 3)[:3]


def test_blocks_meet_without_copies_of_rows(spark, capsys):
    """A pair of blocks meets in a cross join of stored blocks: no row is exploded, and none is shuffled once per other block."""
    rows = spark.range(400).selectExpr("concat('K', id % 20) AS k", "id div 20 AS t", "sin(id) AS v")
    for made in (N.pair_correlations(rows, "k", "t", "v", 5, block=4), N.nearest(rows, "k", "t", "v", 3, 5, block=4)):
        made.explain()
        plan = capsys.readouterr().out
        assert "Generate" not in plan and ("NestedLoopJoin" in plan or "CartesianProduct" in plan)
    assert N.pair_correlations(rows, "k", "t", "v", 5, block=4).count() == 190


def test_pages_and_notes(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(10)], "id int, kind string")
    assert [r.id for r in T.page(rows, [F.col("id").desc()], 2, 1, kind="a", other=None).collect()] == [6, 4]
    with pytest.raises(ValueError):
        T.page(rows, [F.col("id")], 501)
    summary = spark.createDataFrame([(0.1, 0.2), (0.2, 0.1), (None, 0.1)], "ann_return double, benchmark_return double")
    notes = [r.note for r in T.performance(summary, "SPY", True).collect()]
    assert notes == [f"{T.OUT_OF_SAMPLE} {T.BEHIND.format('SPY')}", T.OUT_OF_SAMPLE, T.OUT_OF_SAMPLE]
    assert T.performance(summary, "SPY", False).first().note.endswith(T.SURVIVORS)


def test_sessions_of_spans_at_their_edges(spark):
    calendar = spark.createDataFrame([(day(d),) for d in (2, 3, 5)], "date date")
    spans = spark.createDataFrame([("a", day(3), day(5)), ("b", day(4), day(4)), ("c", day(5), None), ("d", day(9), None), ("e", day(1), day(2))], "k string, start date, end date")
    got = sorted((r.k, r.date.day) for r in D.sessions_of(spans, calendar).collect())
    assert got == [("a", 3), ("a", 5), ("c", 5), ("e", 2)]


def test_documents_that_are_broken_or_empty_give_no_rows(spark):
    docs = spark.createDataFrame([("a", None), ("a", "{"), ("a", "[]"), ("a", '{"facts": {}}'), ("a", '{"facts": {"g": {"T": {"units": {"USD": [{"end": "2024-01-02", "filed": "x", "val": 1}, {"end": "2024-01-02", "filed": "2024-02-01", "val": 2}]}}}}}')],
                                 "ticker string, json string")
    assert [(r.tag, r.val, r.start) for r in D.facts_of(docs).collect()] == [("T", 2.0, None)]
    assert D.filings_of(docs, {"form": "string"}).count() == 0


def test_a_csv_without_a_column_fails(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,name\n1,a\n")
    assert [tuple(r) for r in files.csv_table(spark, str(tmp_path / "x.csv"), "id long, name string").collect()] == [(1, "a")]
    with pytest.raises(Exception, match="(?i)header|column"):
        files.csv_table(spark, str(tmp_path / "x.csv"), "id long, name string, score double").collect()


def test_tags_within_forty_characters(spark):
    said = [("DECISION: buy", "BUY"), ("decision -** SELL", "SELL"), ("DECISION: maybe; " + "x" * 20 + " hold", "HOLD"), ("DECISION: maybe; " + "x" * 60 + " hold", "HOLD?"), ("", "HOLD?")]
    rows = spark.createDataFrame([(t,) for t, _ in said], "t string").select(X.allowed_tag(F.col("t"), "DECISION", ("BUY", "HOLD", "SELL"), "HOLD?").alias("d"))
    assert [r.d for r in rows.collect()] == [w for _, w in said]


def test_values_are_worked_out_once_and_dealt_from_what_is_stored(spark):
    """The rows are counted and dealt into blocks: what they come from runs once."""
    runs = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    rows = spark.range(600).selectExpr("concat('N', id % 10) AS k", "id div 10 AS t", "sin(id) AS v").mapInArrow(told, "k string, t long, v double")
    assert N.pair_correlations(rows, "k", "t", "v", 5, block=4).count() == 45 and runs.value == 600


def test_tickets_sort_the_panel_once(spark):
    """Scores, returns, volatilities and closes of a ticket come from one pass over the panel; no later step sorts it again."""
    from paneltide.plans import desk_queries
    from paneltide.sources.derived import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    made = desk_queries.tickets(t)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "lag(close" not in plan and "stddev_samp(ret" not in plan
    assert made.count() == t.panel.select("date").distinct().count()
