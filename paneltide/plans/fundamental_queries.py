"""Queries of the fundamentals chain, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneltide.operators import fundamentals as X
from paneltide.operators import joins as J
from paneltide.operators import windows as W
from paneltide.plans.registry import query, shown, shown_sql
from paneltide.plans.relational_queries import DAY, EVENTS, reaction_day
from paneltide.plans.window_queries import MKT, RET

TE = ("ticker", "end", "filed")
FIRST = lambda tag: f"""SELECT ticker, start, "end", filed, val FROM facts WHERE tag = '{tag}' QUALIFY row_number() OVER (PARTITION BY ticker, start, "end" ORDER BY filed) = 1"""
QUARTERS = lambda tag: f"""SELECT ticker, "end", filed, val FROM ({FIRST(tag)}) WHERE date_diff('day', start, "end") BETWEEN 80 AND 100"""
TTM = lambda tag: f"""SELECT ticker, "end", filed, ttm FROM (SELECT ticker, "end", sum(val) OVER w4 AS ttm, max(filed) OVER w4 AS filed, count(val) OVER w4 AS n, date_diff('day', lag("end", 3) OVER w, "end") AS span FROM ({QUARTERS(tag)})
 WINDOW w AS (PARTITION BY ticker ORDER BY "end"), w4 AS (PARTITION BY ticker ORDER BY "end" ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) WHERE n = 4 AND span BETWEEN 250 AND 290"""  # noqa: E731


def YOY(inner: str, value: str, safe: bool = False) -> str:
    size = "abs(base)" if safe else "base"
    return f"""SELECT ticker, "end", filed, (v - base) / nullif({size}, 0) AS yoy FROM (SELECT *, {value} AS v, lag({value}, 4) OVER w AS base, date_diff('day', lag("end", 4) OVER w, "end") AS span FROM ({inner}) WINDOW w AS (PARTITION BY ticker ORDER BY "end")) WHERE span BETWEEN 300 AND 430 AND base <> 0"""


INST = lambda tag: f"""SELECT ticker, "end", filed, val FROM (SELECT *, max("end") OVER (PARTITION BY ticker ORDER BY filed, "end" ROWS UNBOUNDED PRECEDING) AS top FROM (SELECT ticker, "end", min(filed) AS filed, arg_min(val, filed) AS val FROM facts WHERE tag = '{tag}' GROUP BY ALL)) WHERE "end" >= top"""


@query("f01_tag_priority", shown_sql("""SELECT ticker, tag, start, "end", filed, val FROM facts WHERE tag IN ('Revenues', 'NetIncomeLoss') QUALIFY row_number() OVER (PARTITION BY ticker, start, "end" ORDER BY CASE tag WHEN 'Revenues' THEN 1 ELSE 2 END, filed) = 1""", ["ticker", "tag", "start", "end", "filed"], ["val"]), ["facts"])
def _(t):
    return shown(X.known(t.facts, ["Revenues", "NetIncomeLoss"]))


YTD = """SELECT ticker, cast(date_trunc('year', start) AS date) AS start, "end", "end" + 40 AS filed, sum(cfo) OVER (PARTITION BY ticker, year(start) ORDER BY "end") AS val FROM quarters"""


def ytd(t):
    w = W.Window.partitionBy("ticker", F.year("start")).orderBy("end")
    return t.quarters.select("ticker", F.to_date(F.date_trunc("year", "start")).alias("start"), "end", F.date_add("end", 40).alias("filed"), F.sum("cfo").over(w).alias("val"))


DIFF = f"""SELECT ticker, prev + 1 AS start, "end", filed, val FROM (SELECT ticker, "end", lag("end") OVER w AS prev, val - lag(val) OVER w AS val, greatest(filed, lag(filed) OVER w) AS filed FROM ({YTD}) WINDOW w AS (PARTITION BY ticker, start ORDER BY "end")) WHERE date_diff('day', prev, "end") BETWEEN 80 AND 100"""


@query("n28_differenced_quarters", shown_sql(DIFF, ["ticker", "start", "end", "filed"], ["val"], 2), ["quarters"])
def _(t):
    return shown(X.differenced_quarters(ytd(t)), digits=2)


ANNUAL = """SELECT ticker, cast(date_trunc('year', start) AS date) AS a, max("end") AS b, max("end") + 60 AS f, sum(rev) AS total FROM quarters GROUP BY ticker, cast(date_trunc('year', start) AS date) HAVING count(*) = 4"""
LASTQ = f"""SELECT ticker, max(q."end") + 1 AS start, b AS "end", greatest(f, max(filed)) AS filed, total - sum(val) AS val FROM ({ANNUAL}) y JOIN ({FIRST('Revenues')}) q USING (ticker) WHERE q.start >= a AND q."end" < b AND date_diff('day', q.start, q."end") BETWEEN 80 AND 100 GROUP BY ticker, a, b, f, total HAVING count(*) = 3"""


@query("f02_last_quarters", shown_sql(LASTQ, ["ticker", "start", "end", "filed"], ["val"], 2), ["quarters", "facts"])
def _(t):
    annual = t.quarters.groupBy("ticker", F.to_date(F.date_trunc("year", "start")).alias("start")).agg(F.max("end").alias("end"), F.date_add(F.max("end"), 60).alias("filed"), F.sum("rev").alias("val"), F.count("*").alias("n")).where("n = 4")
    return shown(X.last_quarters(annual, X.direct_quarters(X.known(t.facts, ["Revenues"]))), digits=2)


@query("f03_merged_quarters", shown_sql(f"""SELECT ticker, "end", filed, val FROM (SELECT ticker, "end", filed, val, 0 AS src FROM ({QUARTERS('OperatingCash')}) UNION ALL SELECT ticker, "end", filed, val, 1 FROM ({DIFF})) QUALIFY row_number() OVER (PARTITION BY ticker, "end" ORDER BY src, filed) = 1""", TE, ["val"], 2), ["quarters", "facts"])
def _(t):
    return shown(X.merged_quarters(X.direct_quarters(X.known(t.facts, ["OperatingCash"])), X.differenced_quarters(ytd(t))), digits=2)


@query("n26_trailing_year", shown_sql(TTM("Revenues"), TE, ["ttm"], 2), ["facts"])
def _(t):
    return shown(X.trailing_year(X.merged_quarters(X.direct_quarters(X.known(t.facts, ["Revenues"])))), digits=2)


@query("n27_year_on_year", shown_sql(YOY(TTM("NetIncomeLoss"), "ttm", True), TE, ["yoy"]), ["facts"])
def _(t):
    return shown(X.year_on_year(X.trailing_year(X.merged_quarters(X.direct_quarters(X.known(t.facts, ["NetIncomeLoss"])))), "ttm", True))


@query("n29_instants", shown_sql(INST("Assets"), TE, ["val"], 2), ["facts"])
def _(t):
    return shown(X.instants(t.facts.where("tag = 'Assets'")), digits=2)


def asof(name: str, inner: str, column: str) -> str:
    return f"ASOF LEFT JOIN (SELECT ticker, filed, arg_max({column}, \"end\") AS {name} FROM ({inner}) GROUP BY ALL) {name}_ ON p.ticker = {name}_.ticker AND p.date > {name}_.filed"


RATIOS = f"""SELECT p.date, p.ticker, ni / CASE WHEN pf > 0 THEN pf END AS fund_ey, cfo / CASE WHEN pf > 0 THEN pf END AS fund_cfo_yield, ni / CASE WHEN equity > 0 THEN equity END AS fund_roe, rev_yoy AS fund_rev_yoy, ni_yoy AS fund_ni_growth, asset_yoy AS fund_asset_growth,
 (ni - cfo) / CASE WHEN assets > 0 THEN assets END AS fund_accruals FROM panel p {asof('ni', TTM('NetIncomeLoss'), 'ttm')} {asof('cfo', TTM('OperatingCash'), 'ttm')} {asof('assets', INST('Assets'), 'val')} {asof('equity', INST('StockholdersEquity'), 'val')} {asof('pf', INST('EntityPublicFloat'), 'val')}
 {asof('rev_yoy', YOY(TTM('Revenues'), 'ttm'), 'yoy')} {asof('ni_yoy', YOY(TTM('NetIncomeLoss'), 'ttm', True), 'yoy')} {asof('asset_yoy', YOY(INST('Assets'), 'val'), 'yoy')}"""
FUND = ["fund_ey", "fund_cfo_yield", "fund_roe", "fund_rev_yoy", "fund_ni_growth", "fund_asset_growth", "fund_accruals"]


@query("f05_f06_fundamental_ratios", shown_sql(RATIOS, ["date", "ticker"], FUND), ["panel", "facts"])
def _(t):
    return shown(X.ratios(t.panel.select("date", "ticker"), t.facts))


SEEN = lambda sql: sql.replace("FROM facts WHERE", "FROM facts WHERE filed < DATE '2000-01-01' AND")
#: The value with the latest filing, and of these the latest end.
NEWEST = lambda inner, column, name: f'LEFT JOIN (SELECT ticker, arg_max({column}, (filed, "end")) AS {name} FROM ({SEEN(inner)}) GROUP BY ticker) USING (ticker)'
SNAPSHOT = f"""SELECT ticker, rev, ni, rev_yoy, ni_yoy, ni / CASE WHEN equity > 0 THEN equity END AS roe, ni / CASE WHEN pf > 0 THEN pf END AS earnings_yield, (ni - cfo) / CASE WHEN assets > 0 THEN assets END AS accruals,
 date_diff('day', last_filed, DATE '2000-01-01') AS days_since, printf('$%.1fB', rev / 1e9) AS rev_text FROM (SELECT ticker, max(filed) AS last_filed FROM facts WHERE filed < DATE '2000-01-01' GROUP BY ticker)
 {NEWEST(TTM('Revenues'), 'ttm', 'rev')} {NEWEST(TTM('NetIncomeLoss'), 'ttm', 'ni')} {NEWEST(TTM('OperatingCash'), 'ttm', 'cfo')} {NEWEST(INST('Assets'), 'val', 'assets')} {NEWEST(INST('StockholdersEquity'), 'val', 'equity')}
 {NEWEST(INST('EntityPublicFloat'), 'val', 'pf')} {NEWEST(YOY(TTM('Revenues'), 'ttm'), 'yoy', 'rev_yoy')} {NEWEST(YOY(TTM('NetIncomeLoss'), 'ttm', True), 'yoy', 'ni_yoy')}"""


@query("f07_fundamental_snapshot", shown_sql(SNAPSHOT, ["ticker", "days_since", "rev_text"], ["rev", "ni", "rev_yoy", "ni_yoy", "roe", "earnings_yield", "accruals"], 3), ["facts"])
def _(t):
    return shown(X.snapshot(t.facts, "2000-01-01"), digits=3)


REACT = f"""SELECT DISTINCT f.ticker, p.date FROM (SELECT *, {DAY} AS day FROM ({EVENTS})) f ASOF JOIN panel p ON f.ticker = p.ticker AND f.day <= p.date"""


@query("n30_announcement_drift", shown_sql(f"""SELECT date, ticker, CASE WHEN idx - ei <= 63 THEN ev END AS pead_surprise, CASE WHEN idx - ei <= 63 THEN idx - ei END AS pead_days_since, CASE WHEN idx - ei <= 63 THEN ev * pow(0.5, (idx - ei) / 21.0) END AS pead_surprise_decay FROM (
 SELECT *, last_value(abn IGNORE NULLS) OVER w AS ev, last_value(CASE WHEN abn IS NOT NULL THEN idx END IGNORE NULLS) OVER w AS ei FROM (SELECT a.*, CASE WHEN h.date IS NOT NULL THEN ret - mkt END AS abn FROM (
 SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS idx FROM ({RET}) JOIN ({MKT}) USING (date)) a LEFT JOIN ({REACT}) h ON a.ticker = h.ticker AND a.date = h.date)
 WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING))""", ["date", "ticker", "pead_days_since"], ["pead_surprise", "pead_surprise_decay"]), ["panel", "filings"])
def _(t):
    return shown(X.drift(t.panel, W.market_return(t.panel), reactions(t)))


def reactions(t):
    """The first session on which each announcement could be traded."""
    events = reaction_day(J.earnings_events(t.filings)).select("ticker", "filed", "day")
    sessions = t.panel.select("ticker", F.col("date").alias("session"))
    return J.as_of(events, sessions, "ticker", "day", "session", ["session"], strict=False, forward=True)


NEWEST_REACTION = f"""SELECT ticker, session FROM (SELECT f.ticker, f.filed, p.date AS session FROM (SELECT *, {DAY} AS day FROM ({EVENTS})) f
 ASOF LEFT JOIN panel p ON f.ticker = p.ticker AND f.day <= p.date) JOIN (SELECT ticker, max(date) AS final FROM panel GROUP BY ticker) USING (ticker)
 WHERE filed <= final QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY filed DESC, session DESC NULLS LAST) = 1"""


@query("n17b_last_reaction", shown_sql(f"""SELECT r.ticker, ret - mkt AS last_earnings_reaction, n - idx AS sessions_since_earnings FROM ({NEWEST_REACTION}) r
 JOIN (SELECT ticker, date, ret, row_number() OVER (PARTITION BY ticker ORDER BY date) AS idx, count(*) OVER (PARTITION BY ticker) AS n FROM ({RET})) x ON x.ticker = r.ticker AND x.date = r.session
 LEFT JOIN ({MKT}) m ON m.date = r.session""", ["ticker", "sessions_since_earnings"], ["last_earnings_reaction"]), ["panel", "filings"])
def _(t):
    return shown(W.last_reaction(t.panel, W.market_return(t.panel), reactions(t)))
