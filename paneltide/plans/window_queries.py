"""Queries of the trailing-window features, with the same definitions in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneltide.operators import windows as W
from paneltide.plans.registry import query, shown, shown_sql

DT = ("date", "ticker")
P = "PARTITION BY ticker ORDER BY date"


def fr(n: int) -> str:
    return f"({P} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(fn: str, x: str, n: int, least: int, frame=fr) -> str:
    return f"CASE WHEN count({x}) OVER {frame(n)} >= {least} THEN {fn}({x}) OVER {frame(n)} END"


def z(x: str, n: int, least: int, frame=fr) -> str:
    return f"({x} - {roll('avg', x, n, least, frame)}) / nullif({roll('stddev_samp', x, n, least, frame)}, 0)"


def chg(x: str, n: int = 1) -> str:
    return f"{x} / nullif(lag({x}, {n}) OVER ({P}), 0) - 1"


def rank_share(x: str, key: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {key} ORDER BY {x} ASC NULLS LAST) + (count({x}) OVER (PARTITION BY {key}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {key}) END"


RET = f"SELECT *, {chg('close')} AS ret FROM panel"
MKT = f"SELECT date, avg(ret) AS mkt FROM ({RET}) GROUP BY date"
SERIES_FRAME = lambda n: f"(ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query("n01_n02_returns", shown_sql(f"SELECT date, ticker, {', '.join(f'{chg(chr(99) + 'lose', n)} AS ret_{n}' for n in (1, 5, 63, 126))} FROM panel", DT, [f"ret_{n}" for n in (1, 5, 63, 126)]), ["panel"])
def _(t):
    return shown(W.returns(t.panel))


@query("n03_reversal", shown_sql(f"SELECT *, {z('rev_ret_5d', 21, 15)} AS rev_z_5d FROM (SELECT date, ticker, {chg('close')} AS rev_ret_1d, {chg('close', 5)} AS rev_ret_5d FROM panel)", DT, ["rev_ret_1d", "rev_ret_5d", "rev_z_5d"]), ["panel"])
def _(t):
    return shown(W.reversal(t.panel))


TREND = f"""SELECT date, ticker, r63 / nullif(vol63 * sqrt(63), 0) AS trend_r63_vol, r126 / nullif(vol63 * sqrt(63), 0) AS trend_r126_vol,
 (close / nullif(sma50, 0) - 1) / nullif(vol21 * sqrt(21), 0) AS trend_sma50_gap, (close / nullif(sma200, 0) - 1) / nullif(vol63 * sqrt(63), 0) AS trend_sma200_gap, vol21 * sqrt(252) AS trend_vol21_ann
 FROM (SELECT *, {chg('close', 63)} AS r63, {chg('close', 126)} AS r126, {roll('stddev_samp', 'ret', 21, 15)} AS vol21, {roll('stddev_samp', 'ret', 63, 40)} AS vol63,
  {roll('avg', 'close', 50, 35)} AS sma50, {roll('avg', 'close', 200, 150)} AS sma200 FROM ({RET}))"""


@query("n04_trend", shown_sql(TREND, DT, ["trend_r63_vol", "trend_r126_vol", "trend_sma50_gap", "trend_sma200_gap", "trend_vol21_ann"]), ["panel"])
def _(t):
    return shown(W.trend(t.panel))


@query("n05_liquidity", shown_sql(f"""SELECT date, ticker, ln(1 + {roll('avg', 'traded', 21, 15)}) AS liq_log_adv21, {z('volume', 21, 15)} AS liq_volume_z, ({roll('avg', 'per', 21, 15)}) * 1e9 AS liq_amihud21
 FROM (SELECT *, close * volume AS traded, abs(ret) / nullif(close * volume, 0) AS per FROM ({RET}))""", DT, ["liq_log_adv21", "liq_volume_z", "liq_amihud21"], 4), ["panel"])
def _(t):
    return shown(W.liquidity(t.panel), digits=4)


@query("n06_residual_momentum", shown_sql(f"""SELECT date, ticker, resmom_beta, lag(rsum, 5) OVER ({P}) AS resmom_126x5, lag(msum, 5) OVER ({P}) AS mom_126x5 FROM (
 SELECT *, {roll('sum', 'resid', 126, 90)} AS rsum, {roll('sum', 'ret', 126, 90)} AS msum FROM (SELECT *, ret - resmom_beta * mkt AS resid FROM (
 SELECT *, (CASE WHEN count(CASE WHEN ret IS NOT NULL AND mkt IS NOT NULL THEN 1 END) OVER {fr(63)} >= 40 THEN covar_samp(ret, mkt) OVER {fr(63)} END) / nullif({roll('var_samp', 'mkt', 63, 40)}, 0) AS resmom_beta
 FROM (SELECT a.*, mkt FROM ({RET}) a LEFT JOIN ({MKT}) USING (date)))))""", DT, ["resmom_beta", "resmom_126x5", "mom_126x5"]), ["panel"])
def _(t):
    return shown(W.residual_momentum(t.panel, W.market_return(t.panel)))


def ffd(d: float) -> str:
    # In the order of the fold: oldest first.
    terms = [f"lag(p, {k}) OVER ({P}) * cast('{w!r}' AS double)" if k else f"p * cast('{w!r}' AS double)" for k, w in reversed(list(enumerate(W.difference_weights(d, 63))))]
    return " + ".join(terms)


@query("n07_fractional_difference", shown_sql(f"SELECT date, ticker, {z('r4', 252, 126)} AS ffd_z_d04, {z('r7', 252, 126)} AS ffd_z_d07 FROM (SELECT date, ticker, {ffd(0.4)} AS r4, {ffd(0.7)} AS r7 FROM (SELECT date, ticker, ln(close) AS p FROM panel))", DT, ["ffd_z_d04", "ffd_z_d07"], 5), ["panel"])
def _(t):
    return shown(W.fractional_difference(t.panel), digits=5)


def area(dx: str, dy: str, n: int = 63) -> str:
    """Sum over pairs of the window itself: half of what each later step turns away from the earlier ones."""
    back = lambda c: f"coalesce(lag({c}, {n}) OVER ({P}), 0)"
    return f"""CASE WHEN count(CASE WHEN {dx} IS NOT NULL AND {dy} IS NOT NULL THEN 1 END) OVER {fr(n)} = {n} THEN
 0.5 * ((pp{dx}{dy} - {back(f'pp{dx}{dy}')} - {back('c' + dx)} * (c{dy} - {back('c' + dy)})) - (qq{dx}{dy} - {back(f'qq{dx}{dy}')} - {back('c' + dy)} * (c{dx} - {back('c' + dx)}))) END"""


ALL = f"({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
SIGNATURE = f"""SELECT date, ticker, {z('tp', 252, 126)} AS sig_tp_area, {z('pv', 252, 126)} AS sig_pv_levy FROM (SELECT *, {area('dt', 'dp')} AS tp, {area('dp', 'dv')} AS pv FROM (
 SELECT *, sum((cdt - coalesce(dt, 0)) * coalesce(dp, 0)) OVER {ALL} AS ppdtdp, sum((cdp - coalesce(dp, 0)) * coalesce(dt, 0)) OVER {ALL} AS qqdtdp,
  sum((cdp - coalesce(dp, 0)) * coalesce(dv, 0)) OVER {ALL} AS ppdpdv, sum((cdv - coalesce(dv, 0)) * coalesce(dp, 0)) OVER {ALL} AS qqdpdv FROM (
 SELECT *, sum(coalesce(dt, 0)) OVER {ALL} AS cdt, sum(coalesce(dp, 0)) OVER {ALL} AS cdp, sum(coalesce(dv, 0)) OVER {ALL} AS cdv FROM (
 SELECT date, ticker, dp, CASE WHEN dp IS NOT NULL THEN 1.0::double / 63 END AS dt, CASE WHEN dp IS NOT NULL THEN greatest(-2.0, least(2.0, dv0)) END AS dv FROM (
 SELECT date, ticker, p - lag(p) OVER ({P}) AS dp, v - lag(v) OVER ({P}) AS dv0 FROM (SELECT date, ticker, ln(close) AS p, ln(greatest(volume, 1)) AS v FROM panel))))))"""


@query("n08_signature_area", shown_sql(SIGNATURE, DT, ["sig_tp_area", "sig_pv_levy"], 4), ["panel"])
def _(t):
    return shown(W.signature(t.panel), digits=4)


NAMES = ["VIX", "VIX3M", "T10Y2Y", "HY_OAS", "DGS10"]
FILL = "(ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
MACRO_WIDE = f"""SELECT date, {', '.join(f'last_value("{c}" IGNORE NULLS) OVER {FILL} AS "{c}"' for c in NAMES)} FROM (SELECT date, {', '.join(f"max(value) FILTER (series = '{c}') AS \"{c}\"" for c in NAMES)} FROM macro GROUP BY date)"""
MACRO_COLUMNS = ["mac_vix", "mac_vix_ts", "mac_t10y2y", "mac_hy_oas_chg21", "mac_dgs10_chg21"]


@query("n09_macro_regime", shown_sql(f"""SELECT p.date, p.ticker, {', '.join(MACRO_COLUMNS)} FROM panel p LEFT JOIN (SELECT date, {', '.join(f'last_value({c} IGNORE NULLS) OVER {FILL} AS {c}' for c in MACRO_COLUMNS)} FROM (SELECT DISTINCT date FROM panel) LEFT JOIN (
 SELECT date, "VIX" AS mac_vix, "VIX3M" / nullif("VIX", 0) AS mac_vix_ts, "T10Y2Y" AS mac_t10y2y, "HY_OAS" - lag("HY_OAS", 21) OVER (ORDER BY date) AS mac_hy_oas_chg21, "DGS10" - lag("DGS10", 21) OVER (ORDER BY date) AS mac_dgs10_chg21
 FROM (SELECT date, {', '.join(f'lag("{c}") OVER (ORDER BY date) AS "{c}"' for c in NAMES)} FROM ({MACRO_WIDE}))) USING (date)) d USING (date)""", DT, MACRO_COLUMNS), ["panel", "macro"])
def _(t):
    return shown(W.macro_regime(t.panel, t.macro))


FWD = f"SELECT date, ticker, lead(close, 5) OVER ({P}) / nullif(close, 0) - 1 AS fwd_ret FROM panel"


@query("n10_labels", shown_sql(f"SELECT date, ticker, fwd_ret, rk - avg(rk) OVER (PARTITION BY date) AS label FROM (SELECT *, {rank_share('fwd_ret', 'date')} AS rk FROM ({FWD}))", DT, ["fwd_ret", "label"]), ["panel"])
def _(t):
    return shown(W.labels(t.panel))


@query("n11_vol_adjusted_labels", shown_sql(f"""SELECT date, ticker, adj, rk - avg(rk) OVER (PARTITION BY date) AS label FROM (SELECT *, {rank_share('adj', 'date')} AS rk FROM (
 SELECT date, ticker, fwd / CASE WHEN vol63 IS NOT NULL THEN greatest(vol63, 1e-4) END AS adj FROM (SELECT date, ticker, lead(close, 5) OVER ({P}) / nullif(close, 0) - 1 AS fwd, {roll('stddev_samp', 'ret', 63, 40)} AS vol63 FROM ({RET}))))""", DT, ["adj", "label"]), ["panel"])
def _(t):
    return shown(W.vol_adjusted_labels(t.panel))


@query("n12_annual_volatility", shown_sql(f"SELECT date, ticker, ({roll('stddev_samp', 'ret', 63, 40)}) * sqrt(252) AS vol63 FROM ({RET})", DT, ["vol63"]), ["panel"])
def _(t):
    return shown(W.annual_volatility(t.panel))


def fold(x: str, rows: int, step: str, first: str) -> str:
    return f"list_reduce(list_prepend({first}, list({x}) OVER {fr(rows)}), lambda a, v: {step})"


KEEP3 = repr(0.5 ** (1 / 3))
EWM = f"list_sum(list_transform(l, lambda v, i: v * pow({KEEP3}, len(l) - i))) / list_sum(list_transform(l, lambda v, i: pow({KEEP3}, len(l) - i)))"


@query("n13_score_smoothing", shown_sql(f"SELECT date, ticker, {EWM} AS smooth FROM (SELECT date, ticker, list(ret) FILTER (ret IS NOT NULL) OVER {fr(160)} AS l FROM ({RET})) WHERE len(l) > 0", DT, ["smooth"]), ["panel"])
def _(t):
    made = W.smoothed(W.with_returns(t.panel), "ret", 3.0)
    return shown(made.where("smooth IS NOT NULL").select("date", "ticker", "smooth"))


def ema(x: str, span: int) -> str:
    """The recursive mean over a list of the last 600 rows: older ones weigh less than a double tells apart."""
    a = repr(2.0 / (span + 1))
    return f"list_sum(list_transform({x}, lambda v, i: v * pow(1 - {a}::double, len({x}) - i) * CASE WHEN i = 1 THEN 1.0::double ELSE {a}::double END))"


MACD = f"""SELECT date, ticker, line, line - {ema("ls", 9)} AS hist FROM (SELECT *, list(line) OVER {fr(600)} AS ls FROM (
 SELECT date, ticker, {ema("l", 12)} - {ema("l", 26)} AS line FROM (SELECT date, ticker, list(close) OVER {fr(600)} AS l FROM panel)))"""


@query("n14_macd", shown_sql(MACD, DT, ["line", "hist"]), ["panel"])
def _(t):
    return shown(W.macd(t.panel))


@query("n15_rsi", shown_sql(f"""SELECT date, ticker, 100 - 100 / (1 + ({roll('avg', 'up', 14, 14)}) / nullif({roll('avg', 'down', 14, 14)}, 0)) AS rsi FROM (
 SELECT date, ticker, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS up, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS down FROM (SELECT date, ticker, close - lag(close) OVER ({P}) AS d FROM panel))""", DT, ["rsi"]), ["panel"])
def _(t):
    return shown(W.rsi(t.panel))


SNAP = [*(f"r{n}" for n in (5, 21, 63, 126)), "vol21", "drawdown_252", "vs_sma50", "vs_sma200", "volume_z"]
LAST = "QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1"


@query("n16_technical_snapshot", shown_sql(f"""SELECT ticker, date, {', '.join(f'{chg(chr(99) + "lose", n)} AS r{n}' for n in (5, 21, 63, 126))}, ({roll('stddev_samp', 'ret', 21, 21)}) * sqrt(252) AS vol21,
 close / max(close) OVER {fr(252)} - 1 AS drawdown_252, close / ({roll('avg', 'close', 50, 50)}) - 1 AS vs_sma50, close / ({roll('avg', 'close', 200, 200)}) - 1 AS vs_sma200,
 (avg(volume) OVER {fr(5)} - avg(volume) OVER {fr(63)}) / nullif(stddev_samp(volume) OVER {fr(63)}, 0) AS volume_z FROM ({RET}) {LAST}""", ("ticker", "date"), SNAP), ["panel"])
def _(t):
    return shown(W.technical_snapshot(t.panel))


def comp(x: str, n: int) -> str:
    return f"exp(sum(ln(1 + {x})) OVER {fr(n)}) - 1"


@query("n17_mood_snapshot", shown_sql(f"""SELECT ticker, date, ({comp('ret', 5)}) - ({comp('mkt', 5)}) AS rel_5d, ({comp('ret', 21)}) - ({comp('mkt', 21)}) AS rel_21d,
 avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END) OVER {fr(21)} AS up_share_21d FROM (SELECT a.*, mkt FROM ({RET}) a LEFT JOIN ({MKT}) USING (date)) {LAST}""", ("ticker", "date"), ["rel_5d", "rel_21d", "up_share_21d"]), ["panel"])
def _(t):
    return shown(W.mood_snapshot(t.panel, W.market_return(t.panel)))


@query("n18_macro_snapshot", shown_sql("""SELECT series, max(value) FILTER (n = 1) AS last, CASE WHEN count(*) > 22 THEN max(value) FILTER (n = 1) - max(value) FILTER (n = 22) END AS change FROM (
 SELECT *, row_number() OVER (PARTITION BY series ORDER BY date DESC) AS n FROM macro WHERE date < DATE '2000-01-01') GROUP BY series""", ["series"], ["last", "change"]), ["macro"])
def _(t):
    return shown(W.macro_snapshot(t.macro, "2000-01-01"))


@query("n18b_vix_term", shown_sql("""SELECT v / m AS vix_term, v / m > 1 AS inverted FROM (
 SELECT arg_max(value, date) FILTER (series = 'VIX') AS v, arg_max(value, date) FILTER (series = 'VIX3M') AS m FROM macro WHERE date < DATE '2000-01-01')""", ["inverted"], ["vix_term"]), ["macro"])
def _(t):
    return shown(W.vix_term(W.macro_snapshot(t.macro, "2000-01-01")))


@query("n19_calendar", "SELECT date, ticker, cast(isodow(date) - 1 AS bigint) AS cal_dow, cast(month(date) AS bigint) AS cal_month, cast(CASE WHEN day(date) <= 3 OR day(date) >= day(last_day(date)) - 2 THEN 1 ELSE 0 END AS bigint) AS cal_turn_of_month FROM panel", ["panel"])
def _(t):
    return W.calendar(t.panel)


XZ = lambda x: f"({x} - avg({x}) OVER (PARTITION BY date)) / nullif(stddev_samp({x}) OVER (PARTITION BY date), 0)"
FALL = f"SELECT date, ticker, (-coalesce({XZ('a')}, 0) + coalesce({XZ('b')}, 0)) / 2 AS score FROM (SELECT date, ticker, {chg('close', 5)} AS a, {chg('close', 21)} AS b FROM panel)"


def scores(t):
    base = t.panel.select("date", "ticker", W.change("close", 5).alias("a"), W.change("close", 21).alias("b"))
    return W.fallback_score(base, "a", "b")


@query("n20_fallback_score", shown_sql(FALL, DT, ["score"]), ["panel"])
def _(t):
    return shown(scores(t))


@query("n21_grades", f"SELECT date, ticker, cast(floor(least(({rank_share('fwd_ret', 'date')}) * 5, 5 - 1e-9)) AS bigint) AS grade FROM ({FWD})", ["panel"])
def _(t):
    return W.grades(W.labels(t.panel).select("date", "ticker", "fwd_ret"), "fwd_ret")


ROUNDED = f"SELECT date, ticker, round(score, 6) AS score FROM ({FALL})"


@query("n22_candidates", shown_sql(f"SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC NULLS LAST, ticker) AS place, {rank_share('score', 'date')} AS score_pct FROM ({ROUNDED}) QUALIFY place <= 10", [*DT, "place"], ["score_pct"]), ["panel"])
def _(t):
    return shown(W.candidates(shown(scores(t)), 5))


@query("n23_ticket_ranks", f"SELECT date, ticker, cast(floor(rank() OVER (PARTITION BY date ORDER BY score DESC) + (count(*) OVER (PARTITION BY date, score) - 1) / 2.0) AS bigint) AS rank FROM ({ROUNDED})", ["panel"])
def _(t):
    return W.ticket_ranks(shown(scores(t)))


@query("n24_high_water", shown_sql(f"SELECT ticker, date, close, max(close) OVER {fr(252)} AS high_water, close / max(close) OVER {fr(252)} - 1 AS drawdown FROM panel", ["ticker", "date"], ["close", "high_water", "drawdown"]), ["panel"])
def _(t):
    return shown(W.high_water(t.panel.select("ticker", "date", "close"), "ticker", "close"))


@query("n25_market_regime_features", shown_sql(f"""SELECT date, {roll('avg', 'mkt', 10, 5, SERIES_FRAME)} AS mean10, {roll('stddev_samp', 'mkt', 10, 5, SERIES_FRAME)} AS vol10, {roll('stddev_samp', 'down', 10, 5, SERIES_FRAME)} AS down10
 FROM (SELECT date, mkt, least(mkt, 0) AS down FROM ({MKT}) WHERE mkt IS NOT NULL) QUALIFY mean10 IS NOT NULL AND vol10 IS NOT NULL AND down10 IS NOT NULL""", ["date"], ["mean10", "vol10", "down10"]), ["panel"])
def _(t):
    return shown(W.market_regime_features(W.market_return(t.panel)))


@query("n31_sessions_between", """SELECT m.ticker, m.start, m."end", count(d.date) AS sessions FROM membership m LEFT JOIN (SELECT DISTINCT date FROM panel) d ON d.date > m.start AND d.date <= m."end"
 WHERE m."end" IS NOT NULL GROUP BY 1, 2, 3""", ["panel", "membership"])
def _(t):
    return W.sessions_between(t.panel, t.membership.where("end IS NOT NULL"))


@query("n32_market_zscore", shown_sql(f"SELECT date, {z('mkt', 252, 126, SERIES_FRAME)} AS z FROM ({MKT})", ["date"], ["z"], 5), ["panel"])
def _(t):
    from pyspark.sql.window import Window

    within = lambda n: Window.orderBy("date").rowsBetween(-(n - 1), 0)
    return shown(W.market_return(t.panel).select("date", W.zscore(F.col("mkt"), 252, 126, within).alias("z")), digits=5)


@query("n33_last_values", "SELECT company_id, id, value, row_number() OVER (PARTITION BY company_id ORDER BY recorded_at DESC, id DESC) AS place FROM kpis QUALIFY place <= 8", ["kpis"])
def _(t):
    return W.last_values(t.kpis, "company_id", ["recorded_at", "id"], 8).select("company_id", "id", "value", "place")
