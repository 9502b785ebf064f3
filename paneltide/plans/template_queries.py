"""Queries behind the endpoints of a service."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneltide.operators import templates as T
from paneltide.operators import windows as W
from paneltide.plans.desk_queries import TICKETS, tickets
from paneltide.plans.registry import query, shown, shown_sql
from paneltide.plans.relational_queries import TOP, top_weights
from paneltide.plans.window_queries import MKT, RET


def newest(at: str) -> list:
    return [F.col(at).desc(), F.col("id").desc()]


@query("e03_pipeline_page", "SELECT * FROM (SELECT id, company_id, stage, updated_at FROM stages WHERE stage = 'sourced' ORDER BY updated_at DESC, id DESC LIMIT 50 OFFSET 20)", ["stages"])
def _(t):
    return T.page(t.stages.select("id", "company_id", "stage", "updated_at"), newest("updated_at"), 50, 20, stage="sourced", company_id=None)


@query("e04_portfolio_page", shown_sql("SELECT id, company_id, metric_name, value FROM (SELECT * FROM kpis WHERE metric_name = 'arr' ORDER BY recorded_at DESC, id DESC LIMIT 100)", ["id", "company_id", "metric_name"], ["value"]), ["kpis"])
def _(t):
    rows = T.page(t.kpis, newest("recorded_at"), 100, metric_name="arr")
    return shown(rows, "id", "company_id", "metric_name", "value")


@query("e05_signals_page", "SELECT id, company_id, signal_type FROM (SELECT * FROM signals WHERE company_id = 7 ORDER BY created_at DESC, id DESC LIMIT 500)", ["signals"])
def _(t):
    rows = T.page(t.signals, newest("created_at"), 500, company_id=7)
    return rows.select("id", "company_id", "signal_type")


@query("e06_latest_ticket", f"SELECT date, markdown FROM ({TICKETS}) QUALIFY date = max(date) OVER ()", ["panel", "macro", "filings"])
def _(t):
    return T.of_day(tickets(t))


#: The book of the day's picks against all names, from session to session.
BOOK = f"SELECT p.date, sum(w * ret) AS r FROM ({TOP}) p JOIN (SELECT ticker, lag(date) OVER (PARTITION BY ticker ORDER BY date) AS date, ret FROM ({RET})) x ON x.ticker = p.ticker AND x.date = p.date WHERE ret IS NOT NULL GROUP BY p.date"


@query("e07_performance", f"""SELECT round(ann_return, 6) + 0.0 AS ann_return, round(benchmark_return, 6) + 0.0 AS benchmark_return, 'Walk-forward out-of-sample, net of modeled costs.' ||
 CASE WHEN ann_return < benchmark_return THEN ' UNDERPERFORMS the equal-weight book buy-and-hold on this window.' ELSE '' END || ' Survivorship bias present (no point-in-time constituents file).' AS note
 FROM (SELECT avg(r) * 252 AS ann_return FROM ({BOOK})), (SELECT avg(mkt) * 252 AS benchmark_return FROM ({MKT}) WHERE mkt IS NOT NULL)""", ["panel"])
def _(t):
    after = W.with_returns(t.panel).select("ticker", F.lag("date").over(W.by_ticker()).alias("date"), "ret").where("ret IS NOT NULL")
    book = top_weights(t).join(after, ["date", "ticker"]).groupBy("date").agg(F.sum(F.col("w") * F.col("ret")).alias("r"))
    market = W.market_return(t.panel).where("mkt IS NOT NULL").agg((F.avg("mkt") * 252).alias("benchmark_return"))
    both = book.agg((F.avg("r") * 252).alias("ann_return")).withColumn("benchmark_return", market.scalar())
    return shown(T.performance(both, "the equal-weight book", point_in_time=False))
