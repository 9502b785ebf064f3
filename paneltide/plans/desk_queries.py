"""Queries of the desk's day: all gates, sizing modes, whole tickets, and the replay with everything fed."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paneltide.operators import iterative as I
from paneltide.operators import joins as J
from paneltide.operators import portfolios as P
from paneltide.operators import tables as K
from paneltide.operators import windows as W
from paneltide.plans.registry import query, shared_path, shown, shown_sql
from paneltide.plans.relational_queries import NEXT, TOP, VIX, changes, vix
from paneltide.plans.strategy_queries import BASE, CAL, REGIME, probs
from paneltide.plans.window_queries import FALL, MKT, RET, roll, scores

#: The market's equity and its highest value of the last 252 sessions.
EQUITY = f"""SELECT date, equity, max(equity) OVER (ORDER BY date ROWS 251 PRECEDING) AS high_water_mark FROM (
 SELECT date, exp(sum(ln(1 + mkt)) OVER (ORDER BY date)) AS equity FROM ({MKT}) WHERE mkt IS NOT NULL)"""
NEAR = "SELECT date, unnest([date, lead(date) OVER w, lead(date, 2) OVER w]) AS day FROM (SELECT DISTINCT date FROM panel) WINDOW w AS (ORDER BY date)"
GATES = f"""SELECT d.date, coalesce(out_, []) AS excluded, (CASE WHEN ratio < 1 THEN 0.5 ELSE 1.0 END * CASE WHEN state = 1 THEN 0.5 ELSE 1.0 END)::double AS exposure_scale,
 NOT (coalesce(ratio < 1, false) OR coalesce(state = 1, false) OR coalesce(deep <= -0.1::double, false)) AS allow_new_entries,
 list_filter([CASE WHEN out_ IS NOT NULL THEN 'earnings exclusion: [''' || array_to_string(out_, ''', ''') || ''']' END,
  CASE WHEN ratio IS NULL THEN 'VIX gate INACTIVE (missing VIX/VIX3M data)'
   WHEN ratio < 1 THEN printf('VIX term structure inverted (VIX3M/VIX=%.2f) — exposure halved, no new entries', round(ratio, 2)) END,
  CASE WHEN state IS NULL THEN 'jump-model gate INACTIVE (no regime state available)' WHEN state = 1 THEN 'jump model: STRESS regime — exposure halved, no new entries' END,
  CASE WHEN deep <= -0.1::double THEN printf('drawdown circuit breaker: %.1f%% from HWM — new entries halted', round(deep * 100, 1)) END], lambda x: x IS NOT NULL) AS notes
 FROM (SELECT DISTINCT date FROM panel) d
 LEFT JOIN (SELECT n.date, list_sort(list_distinct(list(f.ticker))) AS out_ FROM ({NEAR}) n JOIN filings f ON f.filed = n.day AND f.form = '8-K' AND f.items LIKE '%2.02%' GROUP BY n.date) x USING (date)
 LEFT JOIN (SELECT date, CASE WHEN vix > 0 THEN vix3m / vix END AS ratio FROM ({VIX})) v USING (date)
 LEFT JOIN ({REGIME}) r USING (date) LEFT JOIN (SELECT date, equity / high_water_mark - 1 AS deep FROM ({EQUITY})) e USING (date)"""


def market_equity(market):
    days = Window.orderBy("date")  # one row per date
    made = market.where("mkt IS NOT NULL").select("date", F.exp(F.sum(F.log(1 + F.col("mkt"))).over(days)).alias("equity"))
    return made.withColumn("high_water_mark", F.max("equity").over(days.rowsBetween(-251, 0)))


def earnings(t):
    return t.filings.where("form = '8-K' AND items LIKE '%2.02%'").select("ticker", F.col("filed").alias("earnings_date"))


def all_gates(t, states=None, market=None):
    """market: date, mkt of every date of the panel, where they are at hand."""
    market = W.market_return(t.panel) if market is None else market
    falling = market.where("mkt IS NOT NULL").select("date", F.when(F.col("mkt") < -0.01, 1).otherwise(0).alias("state"))
    return P.decisions(market, earnings(t), vix(t), falling if states is None else states, market_equity(market))


@query("b17b_all_gates", f"SELECT date, array_to_string(excluded, ',') AS excluded, exposure_scale, allow_new_entries, array_to_string(notes, '; ') AS notes FROM ({GATES})", ["panel", "macro", "filings"])
def _(t):
    made = all_gates(t)
    return made.select("date", F.array_join("excluded", ",").alias("excluded"), "exposure_scale", "allow_new_entries", F.array_join("notes", "; ").alias("notes"))


_HEAD, _, _TAIL = CAL.rpartition("SELECT a.date")
MULTIPLIERS = {
    "off": "1.0::double", "tilt": "coalesce(prob, 1.0)", "gate": "CASE WHEN prob < 0.5 THEN 0.0 ELSE 1.0 END",
    "sized": "CASE WHEN prob_cal IS NULL OR base_rate IS NULL THEN 1.0 ELSE least(1.0, greatest(0.0, (prob_cal - 0.5) / greatest(base_rate - 0.5, 1e-3::double))) END",
}
MODES = f"{_HEAD}, sizes AS (SELECT a.date{_TAIL}) " + " UNION ALL ".join(
    f"SELECT '{mode}' AS mode, date, ticker, round({mult}, 6) + 0.0 AS size_mult FROM sizes" for mode, mult in MULTIPLIERS.items()
)


def sizes(t):
    """Probabilities of a gain by the rule's score, and what they turned out to be worth in the trailing window."""
    return shown(I.calibrated(probs(t)))


@query("b19b_sizing_modes", MODES, ["panel"])
def _(t):
    modes = F.array(*(F.struct(F.lit(mode).alias("mode"), P.size_of(mode).alias("size_mult")) for mode in MULTIPLIERS))
    return shown(sizes(t).select("date", "ticker", F.inline(modes)).select("mode", "date", "ticker", "size_mult"))


@query("b16b_replay_with_all_inputs")
def _(t):
    """Smoothed scores without names near their earnings, gates with the jump model's regimes, and each mode of sizing."""
    smooth = W.smoothed(shown(scores(t)), "score", 3.0).select("date", "ticker", F.col("smooth").alias("score"))
    gate = all_gates(t, I.jump_regimes(W.market_regime_features(W.market_return(t.panel))))
    out = gate.select("date", F.explode("excluded").alias("ticker"))
    types = t.universe.select("ticker", F.when(F.col("asset_type") == "etf", P.ETF_BPS).otherwise(P.USUAL_BPS).alias("bps"))
    sizings = F.create_map(*(x for mode in MULTIPLIERS for x in (F.lit(mode), P.size_of(mode))))
    mult = sizes(t).select("date", "ticker", sizings.alias("mults"))
    days = P.strategy_days(smooth.join(out, ["date", "ticker"], "left_anti"), t.panel, types, BASE.top_k, BASE.lookback, gate, mult)
    return shown(P.replay(days, {mode: replace(BASE, renormalise=mode == "tilt") for mode in MULTIPLIERS}))


CAPITAL = 100_000.0
TICKETS = f"""WITH chg AS (SELECT date, ticker, coalesce(o.w, 0) AS old, coalesce(n.w, 0) AS new FROM (SELECT d.next AS date, ticker, w FROM ({TOP}) JOIN ({NEXT}) d USING (date) WHERE d.next IS NOT NULL) o
  FULL JOIN ({TOP}) n USING (date, ticker)),
 s AS (SELECT date, ticker, round(score, 4) + 0.0 AS score FROM ({FALL})),
 known AS (SELECT c.*, score, coalesce(score, low, 0) AS s_ FROM chg c LEFT JOIN s USING (date, ticker) LEFT JOIN (SELECT date, min(score) AS low FROM s GROUP BY date) USING (date)),
 ranked AS (SELECT *, floor(rank() OVER (PARTITION BY date ORDER BY s_ DESC) + (count(*) OVER (PARTITION BY date, s_) - 1) / 2.0)::bigint AS rank FROM known),
 lines AS (SELECT r.*, close, new - old AS delta, CASE WHEN abs(new - old) < 1e-9 THEN 'HOLD' WHEN new > old THEN 'BUY' ELSE 'SELL' END AS action,
  floor(abs(new - old) * 100000.0::double / close)::bigint AS n FROM ranked r JOIN panel USING (date, ticker) WHERE close IS NOT NULL),
 told AS (SELECT date, string_agg('| ' || rank || ' | ' || action || ' | ' || ticker || ' | ' || CASE WHEN action = 'HOLD' OR n = 0 THEN '—' ELSE n::varchar END || ' | $' ||
  round(cast(round(close, 6) AS decimal(18,6)) * CASE WHEN action = 'BUY' THEN 1.002::decimal(6,3) ELSE 0.998::decimal(6,3) END, 2)::decimal(18,2)::varchar || ' | $' || printf('%.2f', round(close, 2)) || ' | ' ||
  printf('%.1f%%', round(new * 100, 1)) || ' | ' || coalesce(printf('%+.4f', score), '+nan') || ' |', chr(10) ORDER BY rank, ticker) AS rows_
  FROM lines WHERE NOT (n = 0 AND abs(delta) > 0) AND NOT (action = 'HOLD' AND new = 0) GROUP BY date),
 thin AS (SELECT date, avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) > 0.5 AS fallback FROM (SELECT date, {roll('stddev_samp', 'ret', 63, 40)} AS v FROM ({RET})) GROUP BY date)
 SELECT g.date, '# Panel Desk — Trade Ticket for ' || g.date || chr(10) || chr(10) || 'Mode: **paper**' || CASE WHEN fallback THEN '  |  **FALLBACK MODE** — too few names with a volatility' ELSE '' END ||
  chr(10) || 'Sizing basis: $100,000 (paper)' || chr(10) || chr(10) || CASE WHEN len(notes) > 0 THEN '## Gates' || chr(10) || '- ' || array_to_string(notes, chr(10) || '- ') || chr(10) || chr(10) ELSE '' END ||
  coalesce('{K.TICKET_HEAD}' || chr(10) || rows_, '{K.NO_TRADES}') || chr(10) || chr(10) || '{K.DISCLAIMER}' || chr(10) AS markdown
 FROM ({GATES}) g JOIN thin USING (date) LEFT JOIN told USING (date)"""


@query("w16b_whole_tickets", TICKETS, ["panel", "macro", "filings"])
def tickets(t):
    # All that is taken from the panel comes from one sort by ticker and one by date, and is stored, as it is read several times.
    base = W.with_returns(t.panel).select("date", "ticker", "close", "ret", W.change("close", 5).alias("a"), W.change("close", 21).alias("b"))
    known = base.withColumn("vol63", W.rolled(F.stddev_samp, F.col("ret"), 63, 40))
    path, by_date = shared_path(t.spark, "scored"), shared_path(t.spark, "dates")
    W.fallback_score(known, "a", "b", also=("close", "ret", F.col("vol63").isNull().alias("thin"))).write.parquet(path)
    scored = t.spark.read.parquet(path)
    scored.groupBy("date").agg(F.avg("ret").alias("mkt"), (F.avg(F.col("thin").cast("double")) > 0.5).alias("fallback_mode")).write.parquet(by_date)
    dates = t.spark.read.parquet(by_date)
    rounded = scored.select("date", "ticker", (F.round("score", 4) + F.lit(0.0)).alias("score"))
    lines = K.ticket_lines(changes(t, scored.select("date", "ticker", "score")).select("date", "ticker", "old", "new"), rounded, scored.select("date", "ticker", "close"), CAPITAL)
    days = all_gates(t, market=dates.select("date", "mkt")).select("date", "notes").join(dates.select("date", "fallback_mode"), "date")
    return K.whole_tickets(days.withColumn("reason", F.lit("too few names with a volatility")), lines, CAPITAL, "paper", "Panel Desk")
