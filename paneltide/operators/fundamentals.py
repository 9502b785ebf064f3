"""Quarterly facts from reported vintages, always by the day on which they became known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paneltide.operators.windows import by_ticker, with_returns


def known(facts: DataFrame, tags: list[str]) -> DataFrame:
    """One row per ticker, start and end: the first tag in order that has one, as first filed."""
    order = F.array_position(F.array(*map(F.lit, tags)), F.col("tag"))
    w = Window.partitionBy("ticker", "start", "end").orderBy("_prio", "filed")
    ranked = facts.where(F.col("tag").isin(*tags)).withColumn("_prio", order).withColumn("_n", F.row_number().over(w))
    return ranked.where("_n = 1").drop("_prio", "_n")


def direct_quarters(flows: DataFrame) -> DataFrame:
    return flows.where(F.datediff("end", "start").between(80, 100))


def differenced_quarters(flows: DataFrame) -> DataFrame:
    """Quarters from running totals of one start: each total less the one a quarter before."""
    w = Window.partitionBy("ticker", "start").orderBy("end")
    d = flows.select("ticker", "end", F.lag("end").over(w).alias("_end"), F.col("val") - F.lag("val").over(w), F.greatest("filed", F.lag("filed").over(w)))
    d = d.toDF("ticker", "end", "_end", "val", "filed")
    return d.where(F.datediff("end", "_end").between(80, 100)).select("ticker", F.date_add("_end", 1).alias("start"), "end", "filed", "val")


def last_quarters(annual: DataFrame, quarters: DataFrame) -> DataFrame:
    """A year less exactly three quarters inside it: its last quarter."""
    a = annual.where(F.datediff("end", "start").between(350, 380)).select("ticker", F.col("start").alias("a"), F.col("end").alias("b"), F.col("val").alias("total"), F.col("filed").alias("f"))
    inside = a.join(quarters, "ticker").where("start >= a AND end < b")
    made = inside.groupBy("ticker", "a", "b", "total", "f").agg(F.count("*").alias("n"), F.sum("val").alias("part"), F.max("end").alias("last"), F.max("filed").alias("_f")).where("n = 3")
    return made.select("ticker", F.date_add("last", 1).alias("start"), F.col("b").alias("end"), F.greatest("f", "_f").alias("filed"), (F.col("total") - F.col("part")).alias("val"))


def merged_quarters(*sources: DataFrame) -> DataFrame:
    """Sources in order of trust; one row per ticker and end, the first filed of the most trusted."""
    parts = [s.select("ticker", "end", "filed", "val", F.lit(i).alias("src")) for i, s in enumerate(sources)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    w = Window.partitionBy("ticker", "end").orderBy("src", "filed")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "src")


def trailing_year(quarters: DataFrame) -> DataFrame:
    """Sum of four quarters in a row, known when the last of them was filed."""
    w = Window.partitionBy("ticker").orderBy("end")
    four = w.rowsBetween(-3, 0)
    made = quarters.select("ticker", "end", F.sum("val").over(four).alias("ttm"), F.max("filed").over(four).alias("filed"), F.count("val").over(four).alias("_n"), F.datediff("end", F.lag("end", 3).over(w)).alias("_span"))
    return made.where("_n = 4 AND _span BETWEEN 250 AND 290").select("ticker", "end", "filed", "ttm")


def year_on_year(series: DataFrame, value: str, sign_safe: bool = False) -> DataFrame:
    """Change to the row four before, where that lies about a year back; sign_safe: against its size."""
    w = Window.partitionBy("ticker").orderBy("end")
    base = F.lag(value, 4).over(w)
    size: Column = F.nullif(F.abs(base) if sign_safe else base, F.lit(0.0))
    change = (F.col(value) - base) / size
    made = series.withColumn("yoy", change).withColumn("_span", F.datediff("end", F.lag("end", 4).over(w)))
    return made.where("_span BETWEEN 300 AND 430 AND yoy IS NOT NULL").select("ticker", "end", "filed", "yoy")


def instants(facts: DataFrame) -> DataFrame:
    """Values at a time as first filed, without those older than what was known already."""
    first = facts.groupBy("ticker", "end").agg(F.min("filed").alias("filed"), F.min_by("val", "filed").alias("val"))
    w = Window.partitionBy("ticker").orderBy("filed", "end").rowsBetween(Window.unboundedPreceding, 0)
    return first.withColumn("_top", F.max("end").over(w)).where("end >= _top").drop("_top")


def quarterly(facts: DataFrame, tags: list[str]) -> DataFrame:
    """Quarters of a flow by three ways, in order of trust: as reported, by differences of running totals, a year less its others."""
    flows = known(facts.where("start IS NOT NULL"), tags)
    direct = direct_quarters(flows)
    return merged_quarters(direct, differenced_quarters(flows), last_quarters(flows, direct))


def latest_known(sessions: DataFrame, sources: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Sessions with the last value of each source (ticker, end, filed, value) that was filed before the day.

    All sources run through one sort by ticker: a filing lies behind the sessions of its own day.
    """
    parts = sessions.withColumns({"_day": F.col("date"), "_late": F.lit(0), "_end": F.lit(None).cast("date")})
    for name, (source, column) in sources.items():
        mine = source.where(F.col(column).isNotNull()).select("ticker", F.col("filed").alias("_day"), F.lit(1).alias("_late"), F.col("end").alias("_end"), F.col(column).alias(name))
        parts = parts.unionByName(mine, allowMissingColumns=True)
    w = Window.partitionBy("ticker").orderBy("_day", "_late", "_end").rowsBetween(Window.unboundedPreceding, 0)
    made = parts.withColumns({name: F.last(name, ignorenulls=True).over(w) for name in sources})
    return made.where("_late = 0").select(*sessions.columns, *sources)


def last_known(keys: DataFrame, sources: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """keys (ticker, ...) with each source's value of the latest filing, and of these the latest end: all of it is known.

    Days go into one number, so that values are kept in hash tables and nothing is sorted.
    """
    day = lambda c: F.coalesce(F.unix_date(c) + 719_163, F.lit(0)).cast("long")  # noqa: E731  (from 0, below 2**22)
    both = None
    for name, (source, column) in sources.items():
        mine = source.where(F.col(column).isNotNull()).select("ticker", (day("filed") * 4_194_304 + day("end")).alias("_at"), F.col(column).alias(name))
        both = mine if both is None else both.unionByName(mine, allowMissingColumns=True)
    newest = both.groupBy("ticker").agg(*(F.max_by(name, F.when(F.col(name).isNotNull(), F.col("_at"))).alias(name) for name in sources))
    return keys.join(newest, "ticker", "left")


def figures(facts: DataFrame) -> dict[str, tuple[DataFrame, str]]:
    """The series that ratios are made of, each with the column of its value."""
    ni, rev, cfo = (trailing_year(quarterly(facts, tags)) for tags in (["NetIncomeLoss"], ["Revenues"], ["OperatingCash"]))
    assets, equity, traded = (instants(facts.where(F.col("tag") == x)) for x in ("Assets", "StockholdersEquity", "EntityPublicFloat"))
    return {
        "ni": (ni, "ttm"), "rev": (rev, "ttm"), "cfo": (cfo, "ttm"), "assets": (assets, "val"), "equity": (equity, "val"), "float": (traded, "val"),
        "rev_yoy": (year_on_year(rev, "ttm"), "yoy"), "ni_yoy": (year_on_year(ni, "ttm", sign_safe=True), "yoy"), "asset_yoy": (year_on_year(assets, "val"), "yoy"),
    }


def against(value: Column, base: str) -> Column:
    """NULL where the base is not positive."""
    return value / F.when(F.col(base) > 0, F.col(base))


def ratios(sessions: DataFrame, facts: DataFrame) -> DataFrame:
    """Seven ratios on each session, from what was filed before it; yields are against the public float."""
    made = latest_known(sessions.select("date", "ticker"), figures(facts))
    ni, cfo = F.col("ni"), F.col("cfo")
    return made.select(
        "date", "ticker", against(ni, "float").alias("fund_ey"), against(cfo, "float").alias("fund_cfo_yield"), against(ni, "equity").alias("fund_roe"),
        F.col("rev_yoy").alias("fund_rev_yoy"), F.col("ni_yoy").alias("fund_ni_growth"), F.col("asset_yoy").alias("fund_asset_growth"),
        against(ni - cfo, "assets").alias("fund_accruals"),
    )


def drift(panel: DataFrame, market: DataFrame, reactions: DataFrame, sessions: int = 63, halflife: float = 21.0) -> DataFrame:
    """Abnormal return of the last announcement's session, its age in sessions, and its decayed size.

    reactions: (ticker, session), the first session on which an announcement could be traded.
    """
    base = with_returns(panel).join(market, "date", "left").withColumn("idx", F.row_number().over(by_ticker()))
    hits = reactions.where("session IS NOT NULL").select("ticker", F.col("session").alias("date"), F.lit(1).alias("hit")).distinct()
    marked = base.join(hits, ["ticker", "date"], "left").withColumn("abn", F.when(F.col("hit") == 1, F.col("ret") - F.col("mkt")))
    last = F.last(F.when(F.col("abn").isNotNull(), F.struct("abn", "idx")), ignorenulls=True).over(by_ticker().rowsBetween(Window.unboundedPreceding, 0))
    aged = marked.withColumn("_e", last).withColumn("age", F.col("idx") - F.col("_e.idx"))
    fresh = F.col("age") <= sessions
    return aged.select(
        "date", "ticker", F.when(fresh, F.col("_e.abn")).alias("pead_surprise"), F.when(fresh, F.col("age")).cast("long").alias("pead_days_since"),
        F.when(fresh, F.col("_e.abn") * F.pow(F.lit(0.5), F.col("age") / halflife)).alias("pead_surprise_decay"),
    )


def snapshot(facts: DataFrame, asof: str) -> DataFrame:
    """Latest figures and ratios per ticker from what was filed before a day, and the age of the last filing."""
    day = F.lit(asof).cast("date")
    seen = facts.where(F.col("filed") < day)
    last = seen.groupBy("ticker").agg(F.max("filed").alias("last_filed")).withColumn("date", day)
    made = last_known(last, figures(seen))
    billions = lambda x: F.format_string("$%.1fB", F.col(x) / 1e9)
    return made.select(
        "ticker", "rev", "ni", "rev_yoy", "ni_yoy", against(F.col("ni"), "equity").alias("roe"), against(F.col("ni"), "float").alias("earnings_yield"),
        against(F.col("ni") - F.col("cfo"), "assets").alias("accruals"), F.datediff(day, "last_filed").cast("long").alias("days_since"),
        F.when(F.col("rev").isNotNull(), billions("rev")).alias("rev_text"),
    )
