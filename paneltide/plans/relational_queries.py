"""Queries of joins by time, aggregates, top-k, sets and filters, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneltide.operators import aggregates as A
from paneltide.operators import joins as J
from paneltide.operators import neighbours as N
from paneltide.operators import windows as W
from paneltide.plans.registry import query, shown, shown_sql
from paneltide.plans.window_queries import FALL, FWD, MKT, RET, ROUNDED, fr, rank_share, roll, scores

DT = ("date", "ticker")

# ------------------------------------------------------------------ joins


@query("j01_family_join", shown_sql(f"SELECT a.date, a.ticker, a.fwd_ret, b.score FROM ({FWD}) a LEFT JOIN ({FALL}) b USING (date, ticker)", DT, ["fwd_ret", "score"]), ["panel"])
def _(t):
    return shown(W.labels(t.panel).select("date", "ticker", "fwd_ret").join(scores(t), ["date", "ticker"], "left"))


@query("j02_scores_with_labels", shown_sql(f"SELECT a.date, a.ticker, a.fwd_ret, b.score FROM (SELECT * FROM ({FWD}) WHERE fwd_ret IS NOT NULL) a JOIN ({FALL}) b USING (date, ticker)", DT, ["fwd_ret", "score"]), ["panel"])
def _(t):
    return shown(W.labels(t.panel).where("fwd_ret IS NOT NULL").select("date", "ticker", "fwd_ret").join(scores(t), ["date", "ticker"]))


@query("j03_market_by_date", shown_sql(f"SELECT date, ticker, ret - mkt AS excess FROM ({RET}) JOIN ({MKT}) USING (date)", DT, ["excess"]), ["panel"])
def _(t):
    return shown(W.with_returns(t.panel).join(W.market_return(t.panel), "date").select("date", "ticker", (F.col("ret") - F.col("mkt")).alias("excess")))


MEMBER = 'ticker NOT IN (SELECT ticker FROM membership) OR EXISTS (SELECT 1 FROM membership m WHERE m.ticker = p.ticker AND p.date >= m.start AND (m."end" IS NULL OR p.date <= m."end"))'


@query("j04_p02_membership", f"SELECT date, ticker FROM panel p WHERE {MEMBER}", ["panel", "membership"])
def _(t):
    return J.members(t.panel, t.membership).select("date", "ticker")


@query("j05_as_of_strict", shown_sql("""SELECT p.date, p.ticker, f.val, f.filed FROM panel p ASOF LEFT JOIN (SELECT ticker, filed, arg_max(val, "end") AS val FROM facts WHERE tag = 'Revenues' GROUP BY ALL) f ON p.ticker = f.ticker AND p.date > f.filed""", [*DT, "filed"], ["val"]), ["panel", "facts"])
def _(t):
    revenue = t.facts.where("tag = 'Revenues'")
    return shown(J.as_of(t.panel.select("date", "ticker"), revenue, "ticker", "date", "filed", ["val", "filed"], ties=["end"]))


@query("j05b_as_of_inclusive", shown_sql("""SELECT p.date, p.ticker, f.val FROM panel p ASOF LEFT JOIN (SELECT ticker, filed, arg_max(val, "end") AS val FROM facts WHERE tag = 'Assets' GROUP BY ALL) f ON p.ticker = f.ticker AND p.date >= f.filed""", DT, ["val"]), ["panel", "facts"])
def _(t):
    return shown(J.as_of(t.panel.select("date", "ticker"), t.facts.where("tag = 'Assets'"), "ticker", "date", "filed", ["val"], ties=["end"], strict=False))


DAY = "CASE WHEN coalesce(accepted, cast(filed AS timestamp) + INTERVAL 17 HOUR) < date_trunc('day', coalesce(accepted, cast(filed AS timestamp))) + INTERVAL 570 MINUTE THEN cast(coalesce(accepted, filed) AS date) ELSE cast(coalesce(accepted, filed) AS date) + 1 END"


def reaction_day(filings):
    """The day on which a filing can first be traded: its own before the open, else the next."""
    at = F.expr("coalesce(accepted, cast(filed AS timestamp_ntz) + INTERVAL '17' HOUR)")
    return filings.withColumn("_at", at).withColumn("day", F.expr("CASE WHEN _at < date_trunc('day', _at) + INTERVAL '570' MINUTE THEN to_date(_at) ELSE date_add(to_date(_at), 1) END")).drop("_at")


@query("j06_first_session_at_or_after", f"""SELECT f.ticker, f.form, f.filed, f.day, p.date AS session FROM (SELECT *, {DAY} AS day FROM filings) f ASOF LEFT JOIN panel p ON f.ticker = p.ticker AND f.day <= p.date""", ["panel", "filings"])
def _(t):
    events = reaction_day(t.filings).select("ticker", "form", "filed", "day")
    sessions = t.panel.select("ticker", F.col("date").alias("session"))
    return J.as_of(events, sessions, "ticker", "day", "session", ["session"], strict=False, forward=True)


EVENTS = """SELECT ticker, form, filed, accepted FROM filings WHERE form = '8-K' AND contains(coalesce(items, ''), '2.02') UNION ALL SELECT ticker, form, filed, accepted FROM filings r WHERE form IN ('10-Q', '10-K') AND NOT EXISTS (
 SELECT 1 FROM filings p WHERE p.form = '8-K' AND contains(coalesce(p.items, ''), '2.02') AND p.ticker = r.ticker AND p.filed BETWEEN r.filed - 45 AND r.filed + 7)"""


@query("j07_p16_earnings_events", f"SELECT ticker, form, filed FROM ({EVENTS})", ["filings"])
def _(t):
    return J.earnings_events(t.filings).select("ticker", "form", "filed")


@query("j08_merged_spans", """SELECT ticker, min(start) AS start, CASE WHEN max(e) < DATE '9999-12-31' THEN max(e) END AS "end" FROM (
 SELECT *, sum(new) OVER (PARTITION BY ticker ORDER BY start, e ROWS UNBOUNDED PRECEDING) AS g FROM (
 SELECT *, CASE WHEN date_diff('day', max(e) OVER (PARTITION BY ticker ORDER BY start, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start) <= 7 THEN 0 ELSE 1 END AS new
 FROM (SELECT *, coalesce("end", DATE '9999-12-31') AS e FROM membership))) GROUP BY ticker, g""", ["membership"])
def _(t):
    return J.merged_spans(t.membership)


@query("j09_overlap_days", """SELECT ticker, cast(sum(greatest(0, date_diff('day', greatest(start, DATE '1996-01-01'), least(coalesce("end", DATE '1999-12-31'), DATE '1999-12-31')) + 1)) AS bigint) AS days FROM membership GROUP BY ticker""", ["membership"])
def _(t):
    return J.overlap_days(t.membership, "1996-01-01", "1999-12-31")


VIX = "SELECT date, max(value) FILTER (series = 'VIX') AS vix, max(value) FILTER (series = 'VIX3M') AS vix3m FROM macro GROUP BY date"


def vix(t):
    return t.macro.groupBy("date").pivot("series", ["VIX", "VIX3M"]).agg(F.first("value")).toDF("date", "vix", "vix3m")


@query("j10_exact_date_lookup", shown_sql(f"SELECT d.date, vix, vix3m FROM (SELECT DISTINCT date FROM panel) d LEFT JOIN ({VIX}) USING (date)", ["date"], ["vix", "vix3m"]), ["panel", "macro"])
def _(t):
    return shown(t.panel.select("date").distinct().join(vix(t), "date", "left"))


@query("j11_latest_at_or_before", shown_sql("SELECT series, max(date) AS date, arg_max(value, date) AS value FROM macro WHERE date <= DATE '1999-06-30' GROUP BY series", ["series", "date"], ["value"]), ["macro"])
def _(t):
    return shown(W.latest(t.macro.where("date <= date'1999-06-30'"), "series", "date"))


@query("j12_company_signals", "SELECT c.name, c.sector, s.id, s.signal_type FROM signals s JOIN companies c ON s.company_id = c.id", ["signals", "companies"])
def _(t):
    c = t.companies.select(F.col("id").alias("company_id"), "name", "sector")
    return t.signals.join(c, "company_id").select("name", "sector", "id", "signal_type")


TOP = "SELECT date, ticker, 0.2::double AS w FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC NULLS LAST, ticker) AS n FROM ({0})) WHERE n <= 5".format(ROUNDED)


def top_weights(t, k: int = 5, scored=None):
    """Equal weights of the k best of each date; scored: date, ticker, score where they are at hand."""
    w = W.Window.partitionBy("date").orderBy(F.col("score").desc_nulls_last(), "ticker")
    return shown(scores(t) if scored is None else scored).withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).select("date", "ticker", F.lit(1.0 / k).alias("w"))


NEXT = "SELECT date, lead(date) OVER (ORDER BY date) AS next FROM (SELECT DISTINCT date FROM panel)"


@query("j13_weight_changes", shown_sql(f"SELECT date, ticker, coalesce(o.w, 0) AS old, coalesce(n.w, 0) AS new, coalesce(n.w, 0) - coalesce(o.w, 0) AS delta FROM (SELECT d.next AS date, ticker, w FROM ({TOP}) JOIN ({NEXT}) d USING (date) WHERE d.next IS NOT NULL) o FULL JOIN ({TOP}) n USING (date, ticker)", DT, ["old", "new", "delta"]), ["panel"])
def _(t):
    return shown(changes(t))


def changes(t, scored=None):
    days = (t.panel if scored is None else scored).select("date").distinct().withColumn("next", F.lead("date").over(W.Window.orderBy("date")))
    now = top_weights(t, scored=scored)
    before = now.join(days, "date").where("next IS NOT NULL").select(F.col("next").alias("date"), "ticker", "w")
    return J.aligned(before, now, ["date", "ticker"], "w")


@query("j14_new_names", "SELECT c_name AS name, c_custkey AS id FROM customer WHERE lower(c_name) NOT IN (SELECT lower(name) FROM companies WHERE score IS NOT NULL)", ["companies"])
def _(t):
    incoming = t.raw("customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("id"))
    return J.new_names(incoming, t.companies.where("score IS NOT NULL"))


@query("j16_common_window", shown_sql(f"SELECT date, a.r AS a, b.r AS b FROM (SELECT date, ret AS r FROM ({RET}) WHERE ticker = 'T00001') a JOIN (SELECT date, mkt AS r FROM ({MKT})) b USING (date)", ["date"], ["a", "b"]), ["panel"])
def _(t):
    a = W.with_returns(t.panel).where("ticker = 'T00001'").select("date", F.col("ret").alias("a"))
    return shown(a.join(W.market_return(t.panel).withColumnRenamed("mkt", "b"), "date"))


# ------------------------------------------------------------- aggregates


@query("a01_counts", "SELECT stage, count(*) AS n FROM stages GROUP BY stage", ["stages"])
def _(t):
    return A.counts(t.stages, "stage")


@query("a01b_last_days", "SELECT cast(created_at AS date) AS day, count(*) AS n FROM signals GROUP BY 1 ORDER BY 1 DESC LIMIT 14", ["signals"])
def _(t):
    return A.counts(t.signals.withColumn("day", F.to_date("created_at")), "day").orderBy(F.col("day").desc()).limit(14)


@query("a02_score_buckets", "SELECT " + ", ".join(f"cast(sum(CASE WHEN score BETWEEN {a} AND {b} THEN 1 ELSE 0 END) AS bigint) AS b{a}_{b}" for a, b in ((80, 100), (60, 79), (40, 59), (0, 39))) + " FROM companies", ["companies"])
def _(t):
    return A.buckets(t.companies, "score", [(80, 100), (60, 79), (40, 59), (0, 39)])


@query("a03_paper_gate", "SELECT ticker, count(DISTINCT date) AS days, min(date) AS first, (date_diff('day', min(date), DATE '2001-12-31') >= 90 AND count(DISTINCT date) >= 12) AS open FROM panel GROUP BY ticker", ["panel"])
def _(t):
    return t.panel.groupBy("ticker").agg(F.countDistinct("date").alias("days"), F.min("date").alias("first")).withColumn("open", (F.datediff(F.lit("2001-12-31").cast("date"), "first") >= 90) & (F.col("days") >= 12))


@query("a04_high_of_last", shown_sql("SELECT ticker, max(close) AS high FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM panel) WHERE n <= 252 GROUP BY ticker", ["ticker"], ["high"]), ["panel"])
def _(t):
    return shown(W.last_values(t.panel, "ticker", ["date"], 252).groupBy("ticker").agg(F.max("close").alias("high")))


@query("a05_coverage", "SELECT ticker, count(*) AS n, min(date) AS first, max(date) AS last, count(DISTINCT year(date)) AS years FROM panel GROUP BY ticker", ["panel"])
def _(t):
    return t.panel.groupBy("ticker").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.countDistinct(F.year("date")).alias("years"))


@query("a06_demeaned", shown_sql(f"SELECT date, ticker, ret - avg(ret) OVER (PARTITION BY date) AS x FROM ({RET})", DT, ["x"]), ["panel"])
def _(t):
    return shown(W.with_returns(t.panel).select("date", "ticker", (F.col("ret") - F.avg("ret").over(W.Window.partitionBy("date"))).alias("x")))


@query("a07_a08_a11_a21_summary", shown_sql(f"""SELECT ticker, count(ret) AS n_days, exp(sum(ln(1 + ret)) * 252 / count(ret)) - 1 AS ann_return, avg(ret) * 252 AS ann_mean, stddev_samp(ret) * sqrt(252) AS ann_vol,
 coalesce(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252), 0) AS sharpe, min(drawdown) AS max_drawdown, cast(count(*) FILTER (ret > 0) AS double) / nullif(count(*) FILTER (ret <> 0), 0) AS hit_rate FROM (
 SELECT *, equity / max(equity) OVER (PARTITION BY ticker ORDER BY date) - 1 AS drawdown FROM (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY ticker ORDER BY date)) AS equity FROM ({RET}) WHERE ret IS NOT NULL)) GROUP BY ticker""", ["ticker", "n_days"], ["ann_return", "ann_mean", "ann_vol", "sharpe", "max_drawdown", "hit_rate"]), ["panel"])
def _(t):
    return shown(A.summary(W.with_returns(t.panel), "ret", "ticker"))


MOMENTS = f"SELECT ticker, count(ret) AS n, avg(ret) AS mean, stddev_samp(ret) AS sd, skewness(ret) AS skew, kurtosis(ret) + 3 AS kurtosis FROM ({RET}) GROUP BY ticker HAVING count(ret) > 3"


@query("a09b_sample_moments", shown_sql(MOMENTS, ["ticker", "n"], ["mean", "sd", "skew", "kurtosis"], 5), ["panel"])
def _(t):
    return shown(A.sample_moments(W.with_returns(t.panel), "ret", "ticker"), digits=5)


@query("a09_deflated_sharpe")
def _(t):
    return shown(A.deflated_sharpe(W.with_returns(t.panel), "ret", "ticker", trials=7))


HIT = "(SELECT ticker, count(*) AS n, avg(CASE WHEN ret > 0 THEN 1.0::double ELSE 0.0 END) AS p, 1.959963984540054::double AS z FROM ({0}) WHERE ret <> 0 GROUP BY ticker)".format(RET)


@query("a10_hit_rate_interval", shown_sql(f"SELECT ticker, n, p AS hit_rate, (p + z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n) AS ci_low, (p + z*z/(2*n) + z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n) AS ci_high FROM {HIT}", ["ticker", "n"], ["hit_rate", "ci_low", "ci_high"]), ["panel"])
def _(t):
    return shown(A.hit_rate_interval(W.with_returns(t.panel), "ret", "ticker"))


@query("a12_equity", shown_sql(f"SELECT date, ticker, exp(sum(ln(1 + ret)) OVER (PARTITION BY ticker ORDER BY date)) AS equity FROM ({RET}) WHERE ret IS NOT NULL", DT, ["equity"]), ["panel"])
def _(t):
    return shown(A.equity(W.with_returns(t.panel).where("ret IS NOT NULL"), "ret", "ticker").select("date", "ticker", "equity"))


PREDS = f"SELECT a.date, a.ticker, a.score, b.fwd_ret FROM ({ROUNDED}) a JOIN (SELECT date, ticker, round(fwd_ret, 6) AS fwd_ret FROM ({FWD})) b USING (date, ticker)"
IC = f"SELECT date, covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0) AS ic FROM (SELECT date, {rank_share('score', 'date')} AS a, {rank_share('fwd_ret', 'date')} AS b FROM ({PREDS}) WHERE score IS NOT NULL AND fwd_ret IS NOT NULL) GROUP BY date HAVING count(*) >= 5"


def preds(t):
    """Scores with what followed: both come from one sort of a ticker's rows, so nothing is joined."""
    ahead = (W.over(F.lead("close", 5).over(W.by_ticker()), F.col("close")) - 1).alias("fwd_ret")
    base = t.panel.select("date", "ticker", W.change("close", 5).alias("a"), W.change("close", 21).alias("b"), ahead)
    return shown(W.fallback_score(base, "a", "b", also=("fwd_ret",)).where("date IS NOT NULL AND ticker IS NOT NULL"))


@query("a13_rank_ic", shown_sql(IC, ["date"], ["ic"]), ["panel"])
def _(t):
    return shown(A.rank_ic(preds(t), "score", "fwd_ret"))


@query("a14_ic_summary", shown_sql(f"SELECT year(date) AS fold, count(ic) AS n, avg(ic) AS mean_ic, stddev_samp(ic) AS sd_ic, avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(252) AS ir FROM ({IC}) GROUP BY 1", ["fold", "n"], ["mean_ic", "sd_ic", "ir"]).replace('"fold"', 'cast("fold" AS bigint) AS fold', 1), ["panel"])
def _(t):
    return shown(A.ic_summary(A.rank_ic(preds(t), "score", "fwd_ret"), F.year("date").cast("long")))


PAY = f"SELECT score AS x, CASE WHEN fwd_ret > 0 THEN 1.0::double ELSE 0.0 END AS y FROM ({PREDS}) WHERE fwd_ret IS NOT NULL"


@query("a15_payoff_by_quantile", shown_sql(f"SELECT cast(len(list_filter(list_distinct(cuts), lambda c: c < x)) AS bigint) AS bin, count(*) AS n, avg(y) AS rate FROM ({PAY}), (SELECT quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) AS cuts FROM ({PAY})) GROUP BY 1", ["bin", "n"], ["rate"]), ["panel"])
def _(t):
    return shown(A.payoff_by_quantile(preds(t).where("fwd_ret IS NOT NULL").withColumn("y", F.when(F.col("fwd_ret") > 0, 1.0).otherwise(0.0)), "score", "y"))


@query("a16_sentiment", shown_sql("SELECT signal_type, count(*) AS n, avg(x) AS mean, avg(CASE WHEN x > 0.05 THEN 100.0::double ELSE 0 END) AS positive, avg(CASE WHEN x < -0.05 THEN 100.0::double ELSE 0 END) AS negative, avg(CASE WHEN x BETWEEN -0.05 AND 0.05 THEN 100.0::double ELSE 0 END) AS neutral FROM (SELECT signal_type, value / 100 - 0.5 AS x FROM signals WHERE value IS NOT NULL) GROUP BY 1", ["signal_type", "n"], ["mean", "positive", "negative", "neutral"]), ["signals"])
def _(t):
    return shown(A.sentiment(t.signals.withColumn("x", F.col("value") / 100 - 0.5), "signal_type", "x"))


@query("a17_alerts_by_severity", f"SELECT CASE WHEN abs(ret) >= 0.10 THEN 'high' ELSE 'medium' END AS severity, count(*) AS n FROM ({RET}) WHERE abs(ret) >= 0.05 GROUP BY 1", ["panel"])
def _(t):
    big = W.with_returns(t.panel).where(F.abs("ret") >= 0.05)
    return A.counts(big.withColumn("severity", F.when(F.abs("ret") >= 0.10, "high").otherwise("medium")), "severity")


@query("a18_track_record", shown_sql(f"SELECT ticker, avg(CASE WHEN a > 0 THEN 1.0::double ELSE 0.0 END) AS positive, avg(a) * 1e4 AS mean_bps FROM (SELECT ticker, ret - mkt AS a FROM ({RET}) JOIN ({MKT}) USING (date) WHERE ret IS NOT NULL) GROUP BY ticker", ["ticker"], ["positive", "mean_bps"], 4), ["panel"])
def _(t):
    a = W.with_returns(t.panel).join(W.market_return(t.panel), "date").where("ret IS NOT NULL").withColumn("a", F.col("ret") - F.col("mkt"))
    return shown(a.groupBy("ticker").agg(F.avg(F.when(F.col("a") > 0, 1.0).otherwise(0.0)).alias("positive"), (F.avg("a") * 1e4).alias("mean_bps")), digits=4)


@query("a19_action_counts", f"SELECT ticker, count(*) FILTER (score > 0.5) AS buy, count(*) FILTER (score < -0.5) AS sell, count(*) FILTER (score BETWEEN -0.5 AND 0.5) AS hold FROM ({ROUNDED}) GROUP BY ticker", ["panel"])
def _(t):
    s, n = F.col("score"), lambda c, name: F.sum(F.when(c, 1).otherwise(0)).alias(name)
    return shown(scores(t)).groupBy("ticker").agg(n(s > 0.5, "buy"), n(s < -0.5, "sell"), n(s.between(-0.5, 0.5), "hold"))


@query("a20_equal_weight_book", shown_sql(MKT, ["date"], ["mkt"]), ["panel"])
def _(t):
    return shown(W.market_return(t.panel))


@query("a22_non_null_share", shown_sql(f"SELECT ticker, avg(CASE WHEN v IS NOT NULL THEN 1.0::double ELSE 0.0 END) AS share FROM (SELECT ticker, {roll('stddev_samp', 'ret', 63, 40)} AS v FROM ({RET})) GROUP BY ticker", ["ticker"], ["share"]), ["panel"])
def _(t):
    return shown(W.annual_volatility(t.panel).groupBy("ticker").agg(F.avg(F.col("vol63").isNotNull().cast("double")).alias("share")))


@query("a23_pair_correlations", shown_sql(f"SELECT x.ticker AS a, y.ticker AS b, count(*) AS n, corr(x.ret, y.ret) AS corr FROM ({RET}) x JOIN ({RET}) y ON x.date = y.date AND x.ticker < y.ticker WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 60", ["a", "b", "n"], ["corr"]), ["panel"])
def _(t):
    return shown(N.pair_correlations(W.with_returns(t.panel), "ticker", "date", "ret", 60))


@query("a24_paired_t", shown_sql(f"SELECT ticker, count(*) AS n, avg(ret - mkt) AS mean_diff, avg(ret - mkt) / nullif(stddev_samp(ret - mkt) / sqrt(count(*)), 0) AS t FROM ({RET}) JOIN ({MKT}) USING (date) WHERE ret IS NOT NULL GROUP BY ticker", ["ticker", "n"], ["mean_diff", "t"]), ["panel"])
def _(t):
    return shown(A.paired_t(W.with_returns(t.panel).join(W.market_return(t.panel), "date"), "ret", "mkt", "ticker"))


CHANGES = f"SELECT date, ticker, coalesce(n.w, 0) - coalesce(o.w, 0) AS delta FROM (SELECT d.next AS date, ticker, w FROM ({TOP}) JOIN ({NEXT}) d USING (date) WHERE d.next IS NOT NULL) o FULL JOIN ({TOP}) n USING (date, ticker)"


@query("a25_turnover_costs", shown_sql(f"SELECT date, sum(abs(delta)) AS turnover, sum(abs(delta) * CASE asset_type WHEN 'etf' THEN 3.0 ELSE 7.5 END::double) / 1e4 AS cost FROM ({CHANGES}) LEFT JOIN universe USING (ticker) GROUP BY date", ["date"], ["turnover", "cost"]), ["panel", "universe"])
def _(t):
    return shown(A.turnover_costs(changes(t), t.universe, {"etf": 3.0, "stock": 7.5}, 7.5))


@query("a26_paper_marks", shown_sql(f"SELECT date, sum(w * ret) AS gross FROM ({TOP}) JOIN (SELECT date, ticker, lead(close) OVER (PARTITION BY ticker ORDER BY date) / nullif(close, 0) - 1 AS ret FROM panel) USING (date, ticker) WHERE ret IS NOT NULL GROUP BY date", ["date"], ["gross"]), ["panel"])
def _(t):
    nxt = t.panel.select("date", "ticker", (W.over(F.lead("close").over(W.by_ticker()), F.col("close")) - 1).alias("ret"))
    return shown(top_weights(t).join(nxt, ["date", "ticker"]).where("ret IS NOT NULL").groupBy("date").agg(F.sum(F.col("w") * F.col("ret")).alias("gross")))


# ------------------------------------------------------- top-k, sets, scans


@query("k01_top_k", f"SELECT date, ticker, row_number() OVER (PARTITION BY date ORDER BY score DESC NULLS LAST, ticker) AS place FROM ({ROUNDED}) QUALIFY place <= 5", ["panel"])
def _(t):
    w = W.Window.partitionBy("date").orderBy(F.col("score").desc_nulls_last(), "ticker")
    return shown(scores(t)).withColumn("place", F.row_number().over(w).cast("long")).where("place <= 5").select("date", "ticker", "place")


@query("k02_page", "SELECT id, company_id, signal_type FROM signals ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 100", ["signals"])
def _(t):
    return t.signals.orderBy(F.col("created_at").desc(), F.col("id").desc()).offset(100).limit(50).select("id", "company_id", "signal_type")


@query("k03_p09_top_companies", "SELECT id, name, score FROM companies WHERE score >= 70 AND name <> '_MACRO_DATA_' ORDER BY score DESC, id LIMIT 10", ["companies"])
def _(t):
    return t.companies.where("score >= 70 AND name <> '_MACRO_DATA_'").orderBy(F.col("score").desc(), "id").limit(10).select("id", "name", "score")


CORR = f"SELECT x.ticker AS a, y.ticker AS b, corr(x.ret, y.ret) AS c FROM ({RET}) x JOIN ({RET}) y ON x.date = y.date AND x.ticker <> y.ticker WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 60"


@query("k04_nearest_neighbours", f"SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY round(c, 6) DESC, b) AS place FROM ({CORR}) QUALIFY place <= 5", ["panel"])
def _(t):
    return N.nearest(W.with_returns(t.panel), "ticker", "date", "ret", 5, 60).select("a", "b", "place")


@query("k05_k06_first_vintage", shown_sql("""SELECT ticker, tag, "end", val FROM facts QUALIFY row_number() OVER (PARTITION BY ticker, tag, "end" ORDER BY filed) = 1""", ["ticker", "tag", "end"], ["val"]), ["facts"])
def _(t):
    w = W.Window.partitionBy("ticker", "tag", "end").orderBy("filed")
    return shown(t.facts.withColumn("n", F.row_number().over(w)).where("n = 1").select("ticker", "tag", "end", "val"))


@query("k07_every_nth_session", "SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) AS n FROM (SELECT DISTINCT date FROM panel)) WHERE (n - 1) % 5 = 0", ["panel"])
def _(t):
    return t.panel.select("date").distinct().withColumn("n", F.row_number().over(W.Window.orderBy("date"))).where("(n - 1) % 5 = 0").select("date")


@query("k08_k09_latest_before", shown_sql("SELECT ticker, max(date) AS date, arg_max(close, date) AS close FROM panel WHERE date < DATE '2000-01-01' GROUP BY ticker", ["ticker", "date"], ["close"]), ["panel"])
def _(t):
    return shown(W.latest(t.panel.where("date < date'2000-01-01'").select("ticker", "date", "close"), "ticker", "date"))


@query("k10_lessons", "SELECT company_id, id, 'own' AS kind FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY created_at DESC) AS n FROM signals) WHERE n <= 3 UNION ALL SELECT signal_type::varchar, id, 'cross' FROM (SELECT *, row_number() OVER (PARTITION BY signal_type ORDER BY created_at DESC) AS n FROM signals) WHERE n = 1".replace("SELECT company_id, id", "SELECT company_id::varchar AS key, id"), ["signals"])
def _(t):
    own = W.last_values(t.signals, "company_id", ["created_at"], 3).select(F.col("company_id").cast("string").alias("key"), "id", F.lit("own").alias("kind"))
    cross = W.last_values(t.signals, "signal_type", ["created_at"], 1).select(F.col("signal_type").alias("key"), "id", F.lit("cross").alias("kind"))
    return own.unionByName(cross)


@query("u01_u02_union_with_priority", """SELECT id, src FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY src) AS n FROM (SELECT id, 0 AS src FROM companies WHERE score >= 50 UNION ALL SELECT company_id, 1 FROM stages UNION ALL SELECT company_id, 2 FROM signals)) WHERE n = 1""".replace("SELECT id, src FROM", "SELECT id, cast(src AS bigint) AS src FROM", 1), ["companies", "stages", "signals"])
def _(t):
    tagged = [t.companies.where("score >= 50").select("id", F.lit(0).alias("src")), t.stages.select(F.col("company_id").alias("id"), F.lit(1).alias("src")), t.signals.select(F.col("company_id").alias("id"), F.lit(2).alias("src"))]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).groupBy("id").agg(F.min("src").cast("long").alias("src"))


@query("u03_distinct", "SELECT DISTINCT company_id, signal_type FROM signals", ["signals"])
def _(t):
    return t.signals.select("company_id", "signal_type").distinct()


@query("u05_intersect", "SELECT date FROM panel INTERSECT SELECT date FROM macro", ["panel", "macro"])
def _(t):
    return t.panel.select("date").intersect(t.macro.select("date"))


@query("u06_except", "SELECT id FROM companies EXCEPT SELECT company_id FROM stages", ["companies", "stages"])
def _(t):
    return t.companies.select("id").subtract(t.stages.select(F.col("company_id").alias("id")))


@query("s01_scan_pushed", shown_sql("SELECT * FROM panel WHERE ticker IN ('T00001', 'T00002', 'T00003') AND date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'", DT, ["open", "high", "low", "close", "volume"]), ["panel"])
def _(t):
    return shown(t.panel.where(F.col("ticker").isin("T00001", "T00002", "T00003") & F.col("date").between("1996-01-01", "1997-12-31")))


@query("s13_union_with_name", shown_sql("SELECT date, series, value FROM macro WHERE series IN ('VIX', 'DGS10')", ["date", "series"], ["value"]), ["macro"])
def _(t):
    parts = [t.macro.where(F.col("series") == s).select("date", "value").withColumn("series", F.lit(s)) for s in ("VIX", "DGS10")]
    return shown(parts[0].unionByName(parts[1]))


@query("s19_concept_series", shown_sql("""SELECT ticker, "end", filed, val FROM facts WHERE tag = 'NetIncomeLoss' QUALIFY row_number() OVER (PARTITION BY ticker, "end" ORDER BY filed) = 1""", ["ticker", "end", "filed"], ["val"]), ["facts"])
def _(t):
    return shown(t.facts.where("tag = 'NetIncomeLoss'").groupBy("ticker", "end").agg(F.min("filed").alias("filed"), F.min_by("val", "filed").alias("val")))


@query("s21_s22_latest_value", shown_sql("SELECT series, arg_max(value, date) AS value, max(date) AS date FROM macro GROUP BY series", ["series", "date"], ["value"]), ["macro"])
def _(t):
    return shown(t.macro.groupBy("series").agg(F.max_by("value", "date").alias("value"), F.max("date").alias("date")))


@query("s27_quotes", shown_sql("SELECT ticker, max(close) FILTER (n = 1) AS last, max(close) FILTER (n = 2) AS prev_close, max(close) FILTER (n = 1) / max(close) FILTER (n = 2) - 1 AS change_pct, max(high) FILTER (n = 1) AS day_high, max(close) FILTER (n = 1) / max(high) FILTER (n = 1) - 1 AS from_high_pct FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM panel) WHERE n <= 2 GROUP BY ticker", ["ticker"], ["last", "prev_close", "change_pct", "day_high", "from_high_pct"]), ["panel"])
def _(t):
    two = W.last_values(t.panel, "ticker", ["date"], 2)
    at = lambda c, n: F.max(F.when(F.col("place") == n, F.col(c)))
    return shown(two.groupBy("ticker").agg(at("close", 1).alias("last"), at("close", 2).alias("prev_close"), (at("close", 1) / at("close", 2) - 1).alias("change_pct"), at("high", 1).alias("day_high"), (at("close", 1) / at("high", 1) - 1).alias("from_high_pct")))
