"""Panel, fact, event and CRM tables derived from the relational tables, as DataFrames and as SQL.

A supplier is a ticker: its lineitems of a day make that day's bar. The same derivations are given
as SQL text, so that a query and its oracle start from the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TICKER = "concat('T', lpad(cast({} as string), 5, '0'))"
SERIES = {"1-URGENT": "VIX", "2-HIGH": "VIX3M", "3-MEDIUM": "T10Y2Y", "4-NOT SPECIFIED": "DGS10", "5-LOW": "HY_OAS"}


def hundredths(expression: str) -> Column:
    """A value in whole hundredths: its sums do not depend on the order of rows."""
    return F.floor(F.expr(expression) * 100 + 0.5)


class Tables:
    """The tables of one folder. Each property is a plan; nothing is read until it is used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def panel(self) -> DataFrame:
        unit = F.col("l_extendedprice") / F.col("l_quantity")
        price = lambda x: 10 + F.sqrt(F.sqrt(x))  # noqa: E731  (a calm scale)
        return (
            self.raw("lineitem").where("l_quantity > 0")
            .groupBy(F.to_date("l_shipdate").alias("date"), F.expr(TICKER.format("l_suppkey")).alias("ticker"))
            .agg(F.max(unit).alias("high"), F.min(unit).alias("low"), F.sum(hundredths("l_extendedprice")).alias("paid"), F.sum("l_quantity").alias("volume"))
            .select(
                "date", "ticker", ((price(F.col("low")) + price(F.col("high"))) / 2).alias("open"), price(F.col("high")).alias("high"), price(F.col("low")).alias("low"),
                price(F.col("paid") / (F.lit(100.0) * F.col("volume"))).alias("close"), "volume",
            )
        )

    @cached_property
    def macro(self) -> DataFrame:
        names = F.create_map(*(F.lit(x) for pair in SERIES.items() for x in pair))
        return self.raw("orders").groupBy(F.to_date("o_orderdate").alias("date"), names[F.col("o_orderpriority")].alias("series")).agg(
            F.sqrt(F.sum(hundredths("o_totalprice")) / (F.lit(1e6) * F.count("*"))).alias("value")
        )

    @cached_property
    def universe(self) -> DataFrame:
        s, n = self.raw("supplier"), self.raw("nation")
        return s.join(n, s.s_nationkey == n.n_nationkey).select(
            F.expr(TICKER.format("s_suppkey")).alias("ticker"), F.col("s_name").alias("name"),
            F.when(F.col("s_suppkey") % 5 == 0, "etf").otherwise("stock").alias("asset_type"), F.col("n_name").alias("sector"),
        )

    @cached_property
    def membership(self) -> DataFrame:
        """Windows of some tickers; two for each, the second open for every seventh."""
        s = self.raw("supplier").where("s_suppkey % 3 <> 0").selectExpr("s_suppkey AS k", TICKER.format("s_suppkey") + " AS ticker")
        first = s.selectExpr("ticker", "date_add(date'1995-01-01', cast(k * 37 % 900 AS int)) AS start", "date_add(date'1995-01-01', cast(k * 37 % 900 + k * 53 % 700 AS int)) AS end")
        second = s.selectExpr("ticker", "date_add(date'1998-01-01', cast(k * 41 % 500 AS int)) AS start", "CASE WHEN k % 7 <> 0 THEN date_add(date'1998-01-01', cast(k * 41 % 500 + k * 29 % 900 AS int)) END AS end")
        return first.unionByName(second)

    @cached_property
    def quarters(self) -> DataFrame:
        return (
            self.raw("lineitem").groupBy("l_suppkey", F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("start"))
            .agg(
                (F.sum(hundredths("l_extendedprice")) / 100.0).alias("rev"), (F.sum(hundredths("l_extendedprice * (l_discount - 0.04D)")) / 100.0).alias("ni"),
                (F.sum(hundredths("l_extendedprice * l_tax")) / 100.0).alias("cfo"), F.sum("l_quantity").alias("qty"),
            )
            .withColumn("end", F.expr("date_sub(add_months(start, 3), 1)")).withColumn("ticker", F.expr(TICKER.format("l_suppkey")))
        )

    @cached_property
    def facts(self) -> DataFrame:
        """Fact vintages: ticker, tag, start, end, filed, val; every fifth quarter is restated later."""
        q = self.quarters.withColumn("filed", F.expr("date_add(end, cast(30 + l_suppkey % 20 AS int))"))
        base = q.selectExpr("l_suppkey", "ticker", "filed", "end", "start",
            "stack(6, 'NetIncomeLoss', ni, 0, 'Revenues', rev, 0, 'Assets', qty * 900.0D, 1, 'StockholdersEquity', qty * 400.0D, 1, 'OperatingCash', cfo, 0, 'EntityPublicFloat', rev * 3.0D, 1) AS (tag, val, instant)").where("tag <> 'EntityPublicFloat' OR quarter(end) = 4")
        made = base.selectExpr("l_suppkey", "ticker", "tag", "CASE WHEN instant = 0 THEN start END AS start", "end", "filed", "val")
        again = made.where("(l_suppkey + quarter(end)) % 5 = 0").selectExpr("l_suppkey", "ticker", "tag", "start", "end", "date_add(filed, 90) AS filed", "val * 1.01D AS val")
        return made.unionByName(again).drop("l_suppkey")

    @cached_property
    def filings(self) -> DataFrame:
        """Filing events: ticker, form, filed, accepted, items."""
        q = self.quarters
        report = q.selectExpr("ticker", "'10-Q' AS form", "date_add(end, cast(30 + l_suppkey % 20 AS int)) AS filed", "l_suppkey", "'' AS items")
        news = q.where("l_suppkey % 4 <> 0").selectExpr("ticker", "'8-K' AS form", "date_add(end, cast(22 + l_suppkey % 9 AS int)) AS filed", "l_suppkey", "CASE WHEN l_suppkey % 5 = 1 THEN '5.02,9.01' ELSE '2.02,9.01' END AS items")
        return report.unionByName(news).selectExpr("ticker", "form", "filed", "CASE WHEN l_suppkey % 6 <> 0 THEN cast(filed AS timestamp_ntz) + make_dt_interval(0, cast(7 + l_suppkey % 12 AS int), 0, 0) END AS accepted", "items")

    @cached_property
    def companies(self) -> DataFrame:
        c, n = self.raw("customer"), self.raw("nation")
        return c.join(n, c.c_nationkey == n.n_nationkey).select(
            F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("sector"), F.col("n_name").alias("country"),
            F.when(F.col("c_custkey") % 9 != 0, F.round((F.col("c_acctbal") + 1000) / 110, 1)).alias("score"), F.col("c_acctbal").alias("revenue"),
        )

    @cached_property
    def stages(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS id", "o_custkey AS company_id", "CASE o_orderstatus WHEN 'O' THEN 'sourced' WHEN 'F' THEN 'diligence' ELSE 'closed' END AS stage", "o_orderdate AS updated_at"
        )

    @cached_property
    def kpis(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS id", "o_custkey AS company_id", "CASE WHEN o_orderkey % 3 = 0 THEN 'revenue_growth' ELSE 'arr' END AS metric_name",
            "CASE WHEN o_orderkey % 3 = 0 THEN round(o_totalprice / 200000 - 1, 4) ELSE o_totalprice END AS value", "o_orderdate AS recorded_at"
        )

    @cached_property
    def signals(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "event_id AS id", "user_id AS company_id",
            "CASE event_type WHEN 'view' THEN 'news' WHEN 'click' THEN 'rss' WHEN 'purchase' THEN 'ma' WHEN 'signup' THEN 'sec_8k' ELSE 'price_move' END AS signal_type", "value", "props", "ts AS created_at"
        )


_H = "cast(floor(({}) * 100 + 0.5) AS bigint)"
_T = "concat('T', lpad(cast({} AS varchar), 5, '0'))"
SQL: dict[str, str] = {
    "panel": f"""SELECT date, ticker, (10 + sqrt(sqrt(low)) + (10 + sqrt(sqrt(high)))) / 2 AS open, 10 + sqrt(sqrt(high)) AS high, 10 + sqrt(sqrt(low)) AS low, 10 + sqrt(sqrt(paid / (100.0::double * volume))) AS close, volume FROM (
  SELECT cast(l_shipdate AS date) AS date, {_T.format('l_suppkey')} AS ticker, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, cast(sum({_H.format('l_extendedprice')}) AS double) AS paid, sum(l_quantity) AS volume
  FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2)""",
    "macro": "SELECT cast(o_orderdate AS date) AS date, CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SERIES.items())
    + f" END AS series, sqrt(cast(sum({_H.format('o_totalprice')}) AS double) / (1e6::double * count(*))) AS value FROM orders GROUP BY 1, 2",
    "universe": f"SELECT {_T.format('s_suppkey')} AS ticker, s_name AS name, CASE WHEN s_suppkey % 5 = 0 THEN 'etf' ELSE 'stock' END AS asset_type, n_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "membership": f"""SELECT {_T.format('s_suppkey')} AS ticker, date '1995-01-01' + cast(s_suppkey * 37 % 900 AS int) AS start, date '1995-01-01' + cast(s_suppkey * 37 % 900 + s_suppkey * 53 % 700 AS int) AS "end" FROM supplier WHERE s_suppkey % 3 <> 0
 UNION ALL SELECT {_T.format('s_suppkey')}, date '1998-01-01' + cast(s_suppkey * 41 % 500 AS int), CASE WHEN s_suppkey % 7 <> 0 THEN date '1998-01-01' + cast(s_suppkey * 41 % 500 + s_suppkey * 29 % 900 AS int) END FROM supplier WHERE s_suppkey % 3 <> 0""",
    "quarters": f"""SELECT l_suppkey, {_T.format('l_suppkey')} AS ticker, cast(date_trunc('quarter', l_shipdate) AS date) AS start, cast(date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS date) AS "end",
  cast(sum({_H.format('l_extendedprice')}) AS double) / 100 AS rev, cast(sum({_H.format('l_extendedprice * (l_discount - 0.04::double)')}) AS double) / 100 AS ni, cast(sum({_H.format('l_extendedprice * l_tax')}) AS double) / 100 AS cfo, sum(l_quantity) AS qty FROM lineitem GROUP BY ALL""",
    "facts": """SELECT ticker, tag, start, "end", filed, val FROM (
  WITH base AS (SELECT l_suppkey, ticker, t.tag, CASE WHEN t.instant = 0 THEN start END AS start, "end", "end" + cast(30 + l_suppkey % 20 AS int) AS filed,
    CASE t.tag WHEN 'NetIncomeLoss' THEN ni WHEN 'Revenues' THEN rev WHEN 'Assets' THEN qty * 900.0::double WHEN 'StockholdersEquity' THEN qty * 400.0::double WHEN 'EntityPublicFloat' THEN rev * 3.0::double ELSE cfo END AS val
    FROM quarters, (VALUES ('NetIncomeLoss', 0), ('Revenues', 0), ('Assets', 1), ('StockholdersEquity', 1), ('OperatingCash', 0), ('EntityPublicFloat', 1)) t(tag, instant) WHERE t.tag <> 'EntityPublicFloat' OR quarter("end") = 4)
  SELECT * FROM base UNION ALL SELECT l_suppkey, ticker, tag, start, "end", filed + 90, val * 1.01::double FROM base WHERE (l_suppkey + quarter("end")) % 5 = 0)""",
    "filings": """SELECT ticker, form, filed, CASE WHEN l_suppkey % 6 <> 0 THEN cast(filed AS timestamp) + to_hours(cast(7 + l_suppkey % 12 AS int)) END AS accepted, items FROM (
  SELECT ticker, '10-Q' AS form, "end" + cast(30 + l_suppkey % 20 AS int) AS filed, l_suppkey, '' AS items FROM quarters
  UNION ALL SELECT ticker, '8-K', "end" + cast(22 + l_suppkey % 9 AS int), l_suppkey, CASE WHEN l_suppkey % 5 = 1 THEN '5.02,9.01' ELSE '2.02,9.01' END FROM quarters WHERE l_suppkey % 4 <> 0)""",
    "companies": "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS sector, n_name AS country, CASE WHEN c_custkey % 9 <> 0 THEN round((c_acctbal + 1000) / 110, 1) END AS score, c_acctbal AS revenue FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "stages": "SELECT o_orderkey AS id, o_custkey AS company_id, CASE o_orderstatus WHEN 'O' THEN 'sourced' WHEN 'F' THEN 'diligence' ELSE 'closed' END AS stage, o_orderdate AS updated_at FROM orders",
    "kpis": "SELECT o_orderkey AS id, o_custkey AS company_id, CASE WHEN o_orderkey % 3 = 0 THEN 'revenue_growth' ELSE 'arr' END AS metric_name, CASE WHEN o_orderkey % 3 = 0 THEN round(o_totalprice / 200000 - 1, 4) ELSE o_totalprice END AS value, o_orderdate AS recorded_at FROM orders",
    "signals": "SELECT event_id AS id, user_id AS company_id, CASE event_type WHEN 'view' THEN 'news' WHEN 'click' THEN 'rss' WHEN 'purchase' THEN 'ma' WHEN 'signup' THEN 'sec_8k' ELSE 'price_move' END AS signal_type, value, props, ts AS created_at FROM events",
}
NEEDS = {"facts": ("quarters",), "filings": ("quarters",)}


def with_bases(sql: str, bases: tuple[str, ...]) -> str:
    """sql behind the derivations that it names."""
    wanted: list[str] = []
    for name in bases:
        for x in (*NEEDS.get(name, ()), name):
            if x not in wanted:
                wanted.append(x)
    if not wanted:
        return sql
    bases = ", ".join(f"{x} AS ({SQL[x]})" for x in wanted)
    text = sql.lstrip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if text.upper().startswith(start):
            return f"{start}{bases}, {text[len(start):]}"
    return f"WITH {bases} {sql}"
