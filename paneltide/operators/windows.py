"""Trailing-window features of a long panel (date, ticker, ...): expressions over one sort per ticker.

All frames are trailing rows of a ticker, so no feature sees the future. A window gives NULL until
it holds enough values that are not NULL; a division by zero gives NULL.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window, WindowSpec

from paneltide.operators import moving as M

YEAR = 252


def by_ticker() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("date")


def trailing(n: int) -> WindowSpec:
    return by_ticker().rowsBetween(-(n - 1), 0)


def rolled(fn: Callable[[Column], Column], x: Column, n: int, least: int, within: Callable[[int], WindowSpec] = trailing) -> Column:
    """fn over the last n rows, where at least `least` of them are not NULL."""
    return F.when(F.count(x).over(within(n)) >= least, fn(x).over(within(n)))


def over(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def zscore(x: Column, n: int, least: int, within: Callable[[int], WindowSpec] = trailing) -> Column:
    return over(x - rolled(F.avg, x, n, least, within), rolled(F.stddev_samp, x, n, least, within))


def walked(df: DataFrame, outs: tuple[str, ...], fn: Callable[[dict[str, M.Numbers]], list[M.Numbers]], reads: tuple[str, ...]) -> DataFrame:
    """df with the columns that fn makes of the named ones, a ticker at a time (as long as its calendar), in order of date."""
    layout = StructType([*df.schema, *(StructField(c, DoubleType()) for c in outs)])

    def walk(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [("date", "ascending")], null_placement="at_start"))
        for name, (values, known) in zip(outs, fn({c: M.numbers(rows[c]) for c in reads})):
            rows = rows.append_column(name, pa.array(values, pa.float64(), mask=~known))
        return rows

    return df.groupBy("ticker").applyInArrow(walk, layout)


def change(x: str, n: int = 1) -> Column:
    """Return over n rows."""
    return over(F.col(x), F.lag(x, n).over(by_ticker())) - 1


def pct_rank(x: str, *keys: str, falling: bool = False) -> Column:
    """Average rank among the values of the keys that are not NULL, as a share of their number; one sort by keys and value.

    falling: ranks are counted from the top, so that rows in falling order of the value need no other sort.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(x).desc_nulls_last() if falling else F.col(x).asc_nulls_last())
    ties = F.count(x).over(w.rangeBetween(Window.currentRow, Window.currentRow))
    n = F.count(x).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranked = F.rank().over(w) + (ties - 1) / 2
    return F.when(F.col(x).isNotNull(), (n + 1 - ranked if falling else ranked) / n)


def with_returns(panel: DataFrame) -> DataFrame:
    """The panel with returns over one row; a panel that has them is not sorted again."""
    return panel if "ret" in panel.columns else panel.withColumn("ret", change("close"))


def returns(panel: DataFrame, spans: tuple[int, ...] = (1, 5, 63, 126)) -> DataFrame:
    return panel.select("date", "ticker", *(change("close", n).alias(f"ret_{n}") for n in spans))


def reversal(panel: DataFrame) -> DataFrame:
    base = panel.select("date", "ticker", change("close").alias("rev_ret_1d"), change("close", 5).alias("rev_ret_5d"))
    return base.withColumn("rev_z_5d", zscore(F.col("rev_ret_5d"), 21, 15))


def trend(panel: DataFrame) -> DataFrame:
    base = with_returns(panel)
    ret, close = F.col("ret"), F.col("close")
    made = base.select(
        "date", "ticker", "close", change("close", 63).alias("r63"), change("close", 126).alias("r126"),
        rolled(F.stddev_samp, ret, 21, 15).alias("vol21"), rolled(F.stddev_samp, ret, 63, 40).alias("vol63"),
        rolled(F.avg, close, 50, 35).alias("sma50"), rolled(F.avg, close, 200, 150).alias("sma200"),
    )
    quarter, month = F.col("vol63") * 63**0.5, F.col("vol21") * 21**0.5
    return made.select(
        "date", "ticker", over(F.col("r63"), quarter).alias("trend_r63_vol"), over(F.col("r126"), quarter).alias("trend_r126_vol"),
        over(over(F.col("close"), F.col("sma50")) - 1, month).alias("trend_sma50_gap"), over(over(F.col("close"), F.col("sma200")) - 1, quarter).alias("trend_sma200_gap"),
        (F.col("vol21") * YEAR**0.5).alias("trend_vol21_ann"),
    )


def liquidity(panel: DataFrame) -> DataFrame:
    base = with_returns(panel).withColumn("traded", F.col("close") * F.col("volume"))
    per = over(F.abs("ret"), F.col("traded"))
    return base.withColumn("per", per).select(
        "date", "ticker", F.log1p(rolled(F.avg, F.col("traded"), 21, 15)).alias("liq_log_adv21"), zscore(F.col("volume"), 21, 15).alias("liq_volume_z"),
        (rolled(F.avg, F.col("per"), 21, 15) * 1e9).alias("liq_amihud21"),
    )


def market_return(panel: DataFrame) -> DataFrame:
    """Mean return of a date over all tickers."""
    return with_returns(panel).groupBy("date").agg(F.avg("ret").alias("mkt"))


def residual_momentum(panel: DataFrame, market: DataFrame) -> DataFrame:
    """Beta to a market series (date, mkt), and momentum of what it leaves."""
    base = with_returns(panel).select("date", "ticker", "ret").join(F.broadcast(market.select("date", "mkt")), "date", "left")  # one row per date

    def made(x: dict[str, M.Numbers]) -> list[M.Numbers]:
        (ret, has_ret), (mkt, has_mkt) = x["ret"], x["mkt"]
        both, n_both = M.comoment(ret, mkt, has_ret & has_mkt, 63)
        alone, n_alone = M.comoment(mkt, mkt, has_mkt, 63)
        with np.errstate(invalid="ignore", divide="ignore"):
            spread = np.maximum(alone, 0.0) / (n_alone - 1)
            beta, known = both / (n_both - 1) / spread, (n_both >= 40) & (n_alone >= 40) & (spread != 0)
            resid = ret - beta * mkt
        sums = (M.late(M.summed(y, k, 126, 90), 5) for y, k in ((resid, known & has_ret & has_mkt), (ret, has_ret)))
        return [(beta, known), *sums]

    names = ("resmom_beta", "resmom_126x5", "mom_126x5")
    return walked(base, names, made, ("ret", "mkt")).select("date", "ticker", *names)


def difference_weights(d: float, taps: int) -> list[float]:
    """Weights of a fractional difference: each from the one before."""
    made = [1.0]
    for k in range(1, taps):
        made.append(-made[-1] * (d - k + 1) / k)
    return made


def fractional_difference(panel: DataFrame, orders: tuple[float, ...] = (0.4, 0.7), taps: int = 63) -> DataFrame:
    """Fractionally differenced log prices (newest row first, full windows only), as scores."""
    logs = panel.select("date", "ticker", F.log("close").alias("log"))
    weights = [difference_weights(d, taps) for d in orders]
    names = tuple(f"ffd_z_d{int(d * 10):02d}" for d in orders)
    made = lambda x: [M.zscored(*M.weighted(*x["log"], w), 252, 126) for w in weights]
    return walked(logs, names, made, ("log",)).select("date", "ticker", *names)


def levy_area(df: DataFrame, dx: str, dy: str, n: int, out: str) -> DataFrame:
    """Area between the path of two increments and its chord, over n rows; NULL if one is missing."""
    w, all_before = by_ticker(), by_ticker().rowsBetween(Window.unboundedPreceding, 0)
    x, y = F.coalesce(dx, F.lit(0.0)), F.coalesce(dy, F.lit(0.0))
    df = df.withColumn("_x", F.sum(x).over(all_before)).withColumn("_y", F.sum(y).over(all_before))
    before = lambda c: F.coalesce(F.lag(c).over(w), F.lit(0.0))
    df = df.withColumn("_p", F.sum((F.col("_x") - x) * y).over(all_before)).withColumn("_q", F.sum((F.col("_y") - y) * x).over(all_before))
    at = lambda c: F.coalesce(F.lag(c, n).over(w), F.lit(0.0))
    s12 = F.col("_p") - at("_p") - at("_x") * (F.col("_y") - at("_y"))
    s21 = F.col("_q") - at("_q") - at("_y") * (F.col("_x") - at("_x"))
    df = df.withColumn("_k", F.count(F.when(F.col(dx).isNotNull() & F.col(dy).isNotNull(), 1)).over(all_before))
    whole = F.col("_k") - F.coalesce(F.lag("_k", n).over(w), F.lit(0)) == n
    return df.withColumn(out, F.when(whole, (s12 - s21) * 0.5)).drop("_x", "_y", "_p", "_q", "_k")


def signature(panel: DataFrame, n: int = 63, clip: float = 2.0) -> DataFrame:
    w = by_ticker()
    logs = panel.select("date", "ticker", F.log("close").alias("p"), F.log(F.greatest("volume", F.lit(1.0))).alias("v"))
    steps = logs.select(
        "date", "ticker", (F.col("p") - F.lag("p").over(w)).alias("dp"),
        F.greatest(F.lit(-clip), F.least(F.lit(clip), F.col("v") - F.lag("v").over(w))).alias("dv"),
    )
    steps = steps.withColumn("dv", F.when(F.col("dp").isNotNull(), F.col("dv"))).withColumn("dt", F.when(F.col("dp").isNotNull(), F.lit(1.0 / n)))
    areas = levy_area(levy_area(steps, "dt", "dp", n, "tp"), "dp", "dv", n, "pv")
    names = ("sig_tp_area", "sig_pv_levy")
    made = lambda x: [M.zscored(*x[c], 252, 126) for c in ("tp", "pv")]
    return walked(areas.select("date", "ticker", "tp", "pv"), names, made, ("tp", "pv")).select("date", "ticker", *names)


def macro_regime(panel: DataFrame, macro: DataFrame) -> DataFrame:
    """Macro series known the row before, joined to the panel's dates and carried forward."""
    names = ["VIX", "VIX3M", "T10Y2Y", "HY_OAS", "DGS10"]
    w = Window.orderBy("date")  # one row per date: bounded by the calendar
    filled = w.rowsBetween(Window.unboundedPreceding, 0)
    wide = macro.groupBy("date").pivot("series", names).agg(F.last("value", ignorenulls=True))
    wide = wide.select("date", *(F.last(c, ignorenulls=True).over(filled).alias(c) for c in names))
    late = wide.select("date", *(F.lag(c).over(w).alias(c) for c in names))
    made = late.select(
        "date", F.col("VIX").alias("mac_vix"), over(F.col("VIX3M"), F.col("VIX")).alias("mac_vix_ts"), F.col("T10Y2Y").alias("mac_t10y2y"),
        (F.col("HY_OAS") - F.lag("HY_OAS", 21).over(w)).alias("mac_hy_oas_chg21"), (F.col("DGS10") - F.lag("DGS10", 21).over(w)).alias("mac_dgs10_chg21"),
    )
    columns = made.columns[1:]
    daily = panel.select("date").distinct().join(made, "date", "left").select("date", *(F.last(c, ignorenulls=True).over(filled).alias(c) for c in columns))
    return panel.select("date", "ticker").join(daily, "date", "left")


def labels(panel: DataFrame, horizon: int = 5) -> DataFrame:
    """Forward return and its centred rank among the tickers of the date."""
    made = panel.select("date", "ticker", (over(F.lead("close", horizon).over(by_ticker()), F.col("close")) - 1).alias("fwd_ret"))
    made = made.withColumn("rank", pct_rank("fwd_ret", "date"))
    return made.select("date", "ticker", "fwd_ret", (F.col("rank") - F.avg("rank").over(Window.partitionBy("date"))).alias("label"))


def vol_adjusted_labels(panel: DataFrame, horizon: int = 5) -> DataFrame:
    made = with_returns(panel).select(
        "date", "ticker", (over(F.lead("close", horizon).over(by_ticker()), F.col("close")) - 1).alias("fwd"), rolled(F.stddev_samp, F.col("ret"), 63, 40).alias("vol63")
    )
    made = made.withColumn("adj", F.col("fwd") / F.when(F.col("vol63").isNotNull(), F.greatest("vol63", F.lit(1e-4)))).withColumn("rank", pct_rank("adj", "date"))
    return made.select("date", "ticker", "adj", (F.col("rank") - F.avg("rank").over(Window.partitionBy("date"))).alias("label"))


def annual_volatility(panel: DataFrame) -> DataFrame:
    return with_returns(panel).select("date", "ticker", (rolled(F.stddev_samp, F.col("ret"), 63, 40) * YEAR**0.5).alias("vol63"))


def smoothed(df: DataFrame, x: str, halflife: float, out: str = "smooth") -> DataFrame:
    """Exponential mean of the values so far, with weights that add up to one; a NULL value changes nothing."""
    keep = 0.5 ** (1.0 / halflife)

    def made(c: dict[str, M.Numbers]) -> list[M.Numbers]:
        sums, known = M.decayed(*c[x], keep)
        return [(sums * (1 - keep) / np.where(known, 1 - keep ** np.cumsum(c[x][1]), 1.0), known)]

    return walked(df, (out,), made, (x,))


def macd(panel: DataFrame) -> DataFrame:
    """Difference of two recursive means of the close, and what it lies above its own."""

    def made(c: dict[str, M.Numbers]) -> list[M.Numbers]:
        (fast, known), (slow, _) = (M.recursive_mean(*c["close"], span) for span in (12, 26))
        line = fast - slow
        return [(line, known), (line - M.recursive_mean(line, known, 9)[0], known)]

    return walked(panel.select("date", "ticker", "close"), ("line", "hist"), made, ("close",)).select("date", "ticker", "line", "hist")


def rsi(panel: DataFrame, n: int = 14) -> DataFrame:
    d = panel.select("date", "ticker", (F.col("close") - F.lag("close").over(by_ticker())).alias("d"))
    d = d.withColumn("up", F.when(F.col("d").isNotNull(), F.greatest("d", F.lit(0.0)))).withColumn("down", F.when(F.col("d").isNotNull(), F.greatest(-F.col("d"), F.lit(0.0))))
    return d.select("date", "ticker", (100 - 100 / (1 + over(rolled(F.avg, F.col("up"), n, n), rolled(F.avg, F.col("down"), n, n)))).alias("rsi"))


def technical_snapshot(panel: DataFrame) -> DataFrame:
    """The latest row of each ticker: returns, volatility, drawdown, distances from means, volume; from its last 252 rows, read once."""
    back = F.count("*").over(Window.partitionBy("ticker")) - F.row_number().over(by_ticker())
    rows = with_returns(panel).withColumn("_back", back).where(F.col("_back") < YEAR)  # 0: the latest
    upto = lambda n, c: F.when(F.col("_back") < n, F.col(c))
    at = lambda n, c: F.max(F.when(F.col("_back") == n, F.col(c)))
    full = lambda fn, c, n: F.when(F.count(upto(n, c)) >= n, fn(upto(n, c)))
    close = at(0, "close")
    return rows.groupBy("ticker").agg(
        at(0, "date").alias("date"), *((over(close, at(n, "close")) - 1).alias(f"r{n}") for n in (5, 21, 63, 126)), (full(F.stddev_samp, "ret", 21) * YEAR**0.5).alias("vol21"),
        (close / F.max("close") - 1).alias("drawdown_252"), (close / full(F.avg, "close", 50) - 1).alias("vs_sma50"), (close / full(F.avg, "close", 200) - 1).alias("vs_sma200"),
        over(F.avg(upto(5, "volume")) - F.avg(upto(63, "volume")), F.stddev_samp(upto(63, "volume"))).alias("volume_z"),
    )


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, with partial aggregation before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(key, *(F.col(f"_row.{c}").alias(c) for c in rest))


def mood_snapshot(panel: DataFrame, market: DataFrame) -> DataFrame:
    """Latest return against the market over 5 and 21 rows, and the share of up days."""
    base = with_returns(panel).join(market, "date", "left")
    compound = lambda x, n: F.exp(F.sum(F.log1p(F.col(x))).over(trailing(n))) - 1
    up = F.when(F.col("ret").isNotNull(), F.when(F.col("ret") > 0, 1.0).otherwise(0.0))
    return latest(base.select(
        "ticker", "date", (compound("ret", 5) - compound("mkt", 5)).alias("rel_5d"), (compound("ret", 21) - compound("mkt", 21)).alias("rel_21d"), F.avg(up).over(trailing(21)).alias("up_share_21d")
    ), "ticker", "date")


def macro_snapshot(macro: DataFrame, asof: str, back: int = 21) -> DataFrame:
    """Last value of each series before a date and its change over `back` rows, where more than back + 1 are there."""
    w = Window.partitionBy("series").orderBy(F.col("date").desc())
    n = macro.where(F.col("date") < F.lit(asof).cast("date")).withColumn("n", F.row_number().over(w))
    pick = lambda k: F.max(F.when(F.col("n") == k, F.col("value")))
    change = F.when(F.max("n") > back + 1, pick(1) - pick(back + 1))
    return n.where(F.col("n").isin(1, back + 1, back + 2)).groupBy("series").agg(pick(1).alias("last"), change.alias("change"))


def vix_term(snapshot: DataFrame) -> DataFrame:
    """One row: last VIX over last VIX3M, and whether that is inverted; NULLs where one is missing or VIX3M is not above 0."""
    last = lambda name: F.max(F.when(F.col("series") == name, F.col("last")))
    term = F.when(last("VIX3M") > 0, last("VIX") / F.nullif(last("VIX3M"), F.lit(0.0)))
    return snapshot.agg(term.alias("vix_term")).withColumn("inverted", F.col("vix_term") > 1)


def last_reaction(panel: DataFrame, market: DataFrame, reactions: DataFrame) -> DataFrame:
    """Abnormal return on the session that could first trade a ticker's newest announcement, and the sessions since.

    reactions: (ticker, filed, session). Only what was filed by the ticker's last session counts; a ticker
    whose newest announcement has no session yet has no row, whatever came before.
    """
    ends = panel.groupBy("ticker").agg(F.max("date").alias("asof"))
    known = reactions.join(ends, "ticker").where("filed <= asof")
    newest = known.groupBy("ticker").agg(F.max(F.struct("filed", "session")).getField("session").alias("date"))
    every = Window.partitionBy("ticker")
    numbered = with_returns(panel).select(
        "ticker", "date", "ret", (F.count("*").over(every) - F.row_number().over(by_ticker())).alias("sessions_since_earnings")
    )
    both = numbered.join(newest, ["ticker", "date"]).join(market, "date", "left")
    abnormal = F.col("ret") - F.coalesce("mkt", F.lit(0.0))
    return both.select("ticker", abnormal.alias("last_earnings_reaction"), "sessions_since_earnings")


def calendar(panel: DataFrame) -> DataFrame:
    day, last = F.dayofmonth("date"), F.dayofmonth(F.last_day("date"))
    return panel.select(
        "date", "ticker", F.weekday("date").cast("long").alias("cal_dow"), F.month("date").cast("long").alias("cal_month"),
        F.when((day <= 3) | (day >= last - 2), 1).otherwise(0).cast("long").alias("cal_turn_of_month"),
    )


def cross_z(x: str, *keys: str) -> Column:
    w = Window.partitionBy(*keys)
    return over(F.col(x) - F.avg(x).over(w), F.stddev_samp(x).over(w))


def fallback_score(features: DataFrame, reversal_col: str = "rev_z_5d", momentum_col: str = "resmom_126x5", also: tuple[str, ...] = ()) -> DataFrame:
    zero = F.lit(0.0)
    score = (-F.coalesce(cross_z(reversal_col, "date"), zero) + F.coalesce(cross_z(momentum_col, "date"), zero)) / 2
    return features.select("date", "ticker", score.alias("score"), *also)


def grades(df: DataFrame, x: str, levels: int = 5) -> DataFrame:
    """Relevance 0 to levels-1 by rank among the tickers of the date."""
    share = df.withColumn("share", pct_rank(x, "date"))
    return share.select("date", "ticker", F.floor(F.least(F.col("share") * levels, F.lit(levels - 1e-9))).alias("grade"))


def candidates(scores: DataFrame, top_k: int) -> DataFrame:
    """Rank share of each score and the 2*top_k best of each date."""
    w = Window.partitionBy("date").orderBy(F.col("score").desc_nulls_last(), "ticker")
    made = scores.withColumn("place", F.row_number().over(w).cast("long")).withColumn("score_pct", pct_rank("score", "date", falling=True))
    return made.where(F.col("place") <= 2 * top_k).select("date", "ticker", "score_pct", "place")


def ticket_ranks(scores: DataFrame) -> DataFrame:
    """Average rank from the top, cut to a whole number; a missing score counts as the lowest."""
    low = scores.withColumn("score", F.coalesce("score", F.min("score").over(Window.partitionBy("date"))))
    down = F.rank().over(Window.partitionBy("date").orderBy(F.col("score").desc())) + (F.count("*").over(Window.partitionBy("date", "score")) - 1) / 2
    return low.select("date", "ticker", F.floor(down).alias("rank"))


def high_water(marks: DataFrame, key: str, value: str, n: int = 252) -> DataFrame:
    w = Window.partitionBy(key).orderBy("date").rowsBetween(-(n - 1), 0)
    return marks.select(key, "date", value, F.max(value).over(w).alias("high_water"), (F.col(value) / F.max(value).over(w) - 1).alias("drawdown"))


def market_regime_features(market: DataFrame) -> DataFrame:
    """Ten-row mean, deviation and downside deviation of one series (date, mkt): one row per date."""
    within = lambda n: Window.orderBy("date").rowsBetween(-(n - 1), 0)
    base = market.where("mkt IS NOT NULL").withColumn("down", F.least("mkt", F.lit(0.0)))
    return base.select(
        "date", rolled(F.avg, F.col("mkt"), 10, 5, within).alias("mean10"), rolled(F.stddev_samp, F.col("mkt"), 10, 5, within).alias("vol10"), rolled(F.stddev_samp, F.col("down"), 10, 5, within).alias("down10")
    ).dropna()


def sessions_between(sessions: DataFrame, spans: DataFrame) -> DataFrame:
    """For rows (start, end): the number of distinct sessions in (start, end], from running positions.

    Both bounds look up the last session not after them, so no span meets all its sessions.
    """
    numbered = sessions.select("date").distinct().withColumn("n", F.row_number().over(Window.orderBy("date")))
    bounds = spans.select(F.explode(F.array("start", "end")).alias("at")).distinct()
    both = numbered.select(F.col("date").alias("at"), "n").unionByName(bounds.select("at", F.lit(None).cast("int").alias("n")))
    carried = both.withColumn("upto", F.last("n", ignorenulls=True).over(Window.orderBy("at", F.col("n").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)))
    upto = carried.where("n IS NULL").select("at", F.coalesce("upto", F.lit(0)).alias("upto"))
    return spans.join(upto.toDF("start", "a"), "start").join(upto.toDF("end", "b"), "end").select(*spans.columns, (F.col("b") - F.col("a")).cast("long").alias("sessions"))


def last_values(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The last n rows of each key, numbered from the newest."""
    w = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= n)
