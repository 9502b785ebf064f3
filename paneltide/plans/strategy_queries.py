"""Queries of refit blocks, portfolios, gates, folds and the backtest."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import functions as F

from paneltide.operators import aggregates as A
from paneltide.operators import artifacts as A2
from paneltide.operators import boosting as B
from paneltide.operators import families as X1
from paneltide.operators import iterative as I
from paneltide.operators import portfolios as P
from paneltide.operators import tables as K
from paneltide.operators import windows as W
from paneltide.plans.registry import query, shown, shown_sql
from paneltide.plans.relational_queries import PREDS, TOP, VIX, changes, preds, top_weights, vix
from paneltide.plans.source_queries import _shared as shared
from paneltide.plans.window_queries import DT, FALL, MKT, RET, chg, fr, roll, scores


@query("b01_spillover")
def _(t):
    # Tickers of this panel trade on few sessions: 0.15 of a window is what most of them have.
    return shown(I.spillover(t.panel, least=0.15))


@query("b02_b03_turbulence")
def _(t):
    return shown(I.turbulence(t.panel))


@query("b04_jump_regimes")
def _(t):
    return I.jump_regimes(W.market_regime_features(W.market_return(t.panel)))


CAL = f"""WITH probs AS (SELECT date, ticker, score AS prob, CASE WHEN fwd_ret > 0 THEN 1.0::double ELSE 0.0 END AS hit FROM ({PREDS}) WHERE fwd_ret IS NOT NULL),
 s AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM probs)),
 at_ AS (SELECT p.*, idx, idx // 21 AS block FROM probs p JOIN s USING (date)),
 b AS (SELECT DISTINCT block FROM at_),
 past AS (SELECT b.block, prob, hit FROM b JOIN at_ a ON a.idx < b.block * 21 - 7 AND a.idx >= b.block * 21 - 7 - 252),
 cuts AS (SELECT block, list_sort(list_distinct(quantile_cont(prob, [0.2, 0.4, 0.6, 0.8]))) AS cuts, avg(hit) AS base FROM past GROUP BY block HAVING count(*) >= 500),
 rates AS (SELECT p.block, len(list_filter(cuts, lambda c: c < prob)) AS bin, avg(hit) AS rate FROM past p JOIN cuts USING (block) GROUP BY ALL)
 SELECT a.date, a.ticker, round(prob, 6) + 0.0 AS prob, hit, round(rate, 6) + 0.0 AS prob_cal, round(base, 6) + 0.0 AS base_rate FROM at_ a LEFT JOIN cuts c USING (block) LEFT JOIN rates r ON r.block = a.block AND r.bin = len(list_filter(cuts, lambda c: c < prob))"""


def probs(t):
    return preds(t).where("fwd_ret IS NOT NULL").select("date", "ticker", F.col("score").alias("prob"), F.when(F.col("fwd_ret") > 0, 1.0).otherwise(0.0).alias("hit"))


@query("b05_trailing_calibration", CAL, ["panel"])
def _(t):
    return shown(I.calibrated(probs(t)))


@query("b06_walk_forward_folds", """SELECT (test_start - 520) // 63 AS fold, test_start, least(test_start + 63, n) AS test_end, test_start - 20 AS train_end FROM (SELECT n, unnest(range(520, n, 63)) AS test_start FROM (SELECT count(DISTINCT date) AS n FROM panel))""", ["panel"])
def _(t):
    return I.folds(I.sessions(t.panel), 500, 10, 10, 63)


#: Trees of the registered models: fewer rounds at a higher rate than Boosting's own settings.
QUICK = B.Boosting(rounds=60, rate=0.15, depth=3, bins=16)


def stored(df, t, name):
    path = shared(t, name)
    df.write.parquet(path)
    return t.spark.read.schema(df.schema).parquet(path)


def training_rows(t):
    """All promoted families with the label of each row; rows without a label are left out."""
    rows = X1.build(t.panel, t.macro, list(X1.FAMILIES))
    names = X1.feature_columns(rows)
    known = W.labels(t.panel).where("fwd_ret IS NOT NULL").select("date", "ticker", "fwd_ret")
    return stored(rows.join(W.grades(known, "fwd_ret").join(known, ["date", "ticker"]), ["date", "ticker"]), t, "training"), names


def fold_plan(rows, least: int):
    numbered = I.sessions(rows)
    return [tuple(r) for r in I.folds(numbered, least, 5, 2, 63).orderBy("fold").collect()], numbered


@query("b07_walk_forward_ranker")
def _(t):
    rows, names = training_rows(t)
    return shown(B.walk_forward(rows, names, "grade", *fold_plan(rows, 504), QUICK).scores)


@query("b08_walk_forward_classifier")
def _(t):
    """Whether a candidate of the pool gains: twice the picks of a date by the rule's score, with the rank of that score."""
    # One sort of the panel gives what is needed of all tickers: returns, and the changes that the rule scores.
    panel = t.panel.select("date", "ticker", "close", "volume", W.change("close").alias("ret"), W.change("close", 5).alias("a"), W.change("close", 21).alias("b"))
    panel = stored(panel, t, "panel")
    # The pool first: 2 * top_k rows a date, and features of those rows only.
    pool = stored(W.candidates(shown(W.fallback_score(panel, "a", "b")), BASE.top_k).select("date", "ticker", "score_pct"), t, "candidates")
    panel = panel.drop("a", "b")
    features = X1.build(panel, t.macro, list(X1.FAMILIES), only=pool)
    names = X1.feature_columns(features)
    theirs = panel.join(F.broadcast(pool.select("ticker").distinct()), "ticker", "left_semi")  # a label is of its ticker's rows alone
    known = W.labels(theirs).where("fwd_ret IS NOT NULL").select("date", "ticker", "fwd_ret").join(F.broadcast(pool), ["date", "ticker"])
    meta = stored(known.join(features, ["date", "ticker"]).withColumn("hit", (F.col("fwd_ret") > 0).cast("int")), t, "pool")
    how = replace(QUICK, objective="binary")
    return shown(B.walk_forward(meta, [*names, "score_pct"], "hit", *fold_plan(meta, 252), how).scores)


STUMP = [(0, 0, 0, "r5", 0.0, None), (0, 0, 1, None, None, 0.25), (0, 0, 2, None, None, -0.5)]
CASES = {
    "model": (STUMP, ["r5"], "model"), "constant": ([STUMP[0], STUMP[1], (*STUMP[2][:5], 0.25)], ["r5"], "model produced constant scores"),
    "schema": (STUMP, ["r5", "other_col"], "feature schema mismatch (missing: other_col)"), "none": (None, None, "no model artifact promoted"),
}
RULE = f"SELECT date, ticker, score FROM ({FALL})"
MODEL_SCORE = f"SELECT date, ticker, CASE WHEN r5 > 0 THEN -0.5 ELSE 0.25 END AS score FROM (SELECT date, ticker, {chg('close', 5)} AS r5 FROM panel)"


@query("b09_w12_scored_with_fallback", shown_sql(" UNION ALL ".join(
    f"SELECT '{case}' AS case_of, date, ticker, score, {str(reason != 'model').lower()} AS fallback_mode, '{reason}' AS reason FROM ({MODEL_SCORE if reason == 'model' else RULE})"
    for case, (_, _, reason) in CASES.items()), ["case_of", *DT, "fallback_mode", "reason"], ["score"]), ["panel"])
def _(t):
    """A registry for each case: a model that is saved, promoted, loaded by its pointer and scored with, or not."""
    # Features and the rule's scores are worked out once, whatever the number of cases.
    features = stored(t.panel.select("date", "ticker", W.change("close", 5).alias("r5"), W.change("close", 21).alias("r21")), t, "features")
    rule = stored(W.fallback_score(features, "r5", "r21"), t, "rule")
    made = []
    for case, (trees, names, _) in CASES.items():
        folder = shared(t, f"registry-{case}")
        if trees is not None:
            A2.save(t.spark.createDataFrame([], B.TREES), ["r21"], folder, "v1")
            A2.promote(t.spark, folder, "v1")
            A2.save(t.spark.createDataFrame(trees, B.TREES), names, folder, "v2")
            A2.promote(t.spark, folder, "v2")
        result = A2.score(features, A2.current(t.spark, folder), lambda _: rule)
        made.append(shown(result.scores).select(F.lit(case).alias("case_of"), "*"))
    return reduce(lambda a, b: a.unionByName(b), made)


@query("b09_fallback_where_thin", shown_sql(f"""SELECT date, avg(CASE WHEN rsq IS NULL THEN 1.0::double ELSE 0.0 END) AS missing, (avg(CASE WHEN rsq IS NULL THEN 1.0::double ELSE 0.0 END) > 0.5) AS fallback FROM (SELECT date, {roll('stddev_samp', 'ret', 63, 40)} AS rsq FROM ({RET})) GROUP BY date""", ["date", "fallback"], ["missing"]), ["panel"])
def _(t):
    day = W.annual_volatility(t.panel).groupBy("date").agg(F.avg(F.col("vol63").isNull().cast("double")).alias("missing"))
    return shown(day.withColumn("fallback", F.col("missing") > 0.5))


def picks_with_vol(t):
    vol = P.rolled_vol(t.panel).select("date", "ticker", "vol")
    return top_weights(t).select("date", "ticker").join(vol, ["date", "ticker"]).where("vol IS NOT NULL")


VOLS = f"SELECT date, ticker, 1 / greatest(vol, 1e-6::double) AS share FROM ({TOP}) JOIN (SELECT date, ticker, {roll('stddev_samp', 'ret', 63, 40)} * sqrt(252) AS vol FROM ({RET})) USING (date, ticker) WHERE vol IS NOT NULL"
#: At the right number of names on the cap, the weights of the others sum up to what the cap leaves.
INVERSE = f"""WITH v AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY share DESC, ticker) AS n, count(*) OVER (PARTITION BY date) AS names FROM ({VOLS})),
 m AS (SELECT a.date, a.n - 1 AS at_cap, (1 - 0.4::double * (a.n - 1)) / sum(b.share) AS level, max(b.share) AS most FROM v a JOIN v b ON a.date = b.date AND b.n >= a.n GROUP BY a.date, a.n),
 f AS (SELECT date, arg_min(level, at_cap) AS level FROM m WHERE most * level <= 0.4::double + 1e-12 GROUP BY date)
 SELECT v.date, v.ticker, round(least(0.4::double, coalesce(share * level, 0.4::double)), 6) + 0.0 AS weight FROM v LEFT JOIN f USING (date)"""


@query("b11_inverse_volatility", INVERSE, ["panel"])
def _(t):
    return shown(P.inverse_volatility(picks_with_vol(t), 0.4))


SESSIONS = "SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM panel)"
SCALE = f"""SELECT date, stddev_samp(r) * sqrt(252) AS vol FROM (SELECT p.date, k.idx, sum(w * coalesce(ret, 0)) AS r FROM ({TOP}) p JOIN ({SESSIONS}) s USING (date) JOIN ({SESSIONS}) k ON k.idx BETWEEN s.idx - 62 AND s.idx
 LEFT JOIN ({RET}) x ON x.date = k.date AND x.ticker = p.ticker GROUP BY p.date, k.idx) GROUP BY date"""


@query("b12_vol_target", shown_sql(f"SELECT date, vol, CASE WHEN vol > 0 THEN least(1.0, 0.15::double / vol) ELSE 1.0 END AS scale FROM ({SCALE})", ["date"], ["vol", "scale"]), ["panel"])
def _(t):
    return shown(P.vol_target(top_weights(t).withColumnRenamed("w", "weight"), t.panel, 0.15))


@query("b13_trade_band", shown_sql(f"""SELECT date, ticker, weight FROM (SELECT coalesce(n.date, o.date) AS date, coalesce(n.ticker, o.ticker) AS ticker, CASE WHEN abs(coalesce(n.w, 0) - coalesce(o.w, 0)) < 0.05 THEN coalesce(o.w, 0) ELSE coalesce(n.w, 0) END AS weight
 FROM (SELECT date, ticker, 0.04::double AS w FROM panel WHERE ticker < 'T00020') o FULL JOIN (SELECT date, ticker, w FROM ({TOP})) n ON o.date = n.date AND o.ticker = n.ticker) WHERE weight > 0""", ["date", "ticker"], ["weight"]), ["panel"])
def _(t):
    old = t.panel.where("ticker < 'T00020'").select("date", "ticker", F.lit(0.04).alias("weight"))
    return shown(P.trade_band(top_weights(t).withColumnRenamed("w", "weight"), old, 0.05))


def scheme(t, name):
    return shown(P.scheme_weights(t.panel, top_weights(t).select("date", "ticker"), name))


@query("b14_risk_parity")
def _(t):
    return scheme(t, "hrp")


@query("b15_cleaned_min_variance")
def _(t):
    return scheme(t, "rmt_minvar")


REGIME = f"SELECT date, CASE WHEN mkt < -0.01 THEN 1 ELSE 0 END AS state FROM ({MKT}) WHERE mkt IS NOT NULL"


@query("b17_gates", f"""SELECT date, (CASE WHEN inv THEN 0.5 ELSE 1.0 END * CASE WHEN state = 1 THEN 0.5 ELSE 1.0 END)::double AS exposure_scale, NOT (coalesce(inv, false) OR coalesce(state = 1, false)) AS allow_new_entries,
 concat_ws('; ', CASE WHEN vix IS NULL OR vix3m IS NULL OR vix <= 0 THEN 'VIX gate INACTIVE' WHEN inv THEN 'VIX term structure inverted' END, CASE WHEN state IS NULL THEN 'jump-model gate INACTIVE' WHEN state = 1 THEN 'jump model: STRESS' END) AS notes
 FROM (SELECT coalesce(v.date, r.date) AS date, vix, vix3m, state, vix3m / nullif(CASE WHEN vix > 0 THEN vix END, 0) < 1 AS inv FROM ({VIX}) v FULL JOIN ({REGIME}) r ON v.date = r.date)""", ["panel", "macro"])
def _(t):
    states = W.market_return(t.panel).where("mkt IS NOT NULL").select("date", F.when(F.col("mkt") < -0.01, 1).otherwise(0).alias("state"))
    return P.gates(vix(t), states)


#: Cadences, weightings and bands that are compared with each other, over the same picks.
BASE = P.Strategy(top_k=5, max_weight=0.4, vol_target=0.15, band=0.02)
VARIANTS = {
    "daily": BASE, "weekly": replace(BASE, every=5), "monthly": replace(BASE, every=21), "wide band": replace(BASE, band=0.05),
    "weekly hrp": replace(BASE, every=5, weighting="hrp"), "weekly min variance": replace(BASE, every=5, weighting="rmt_minvar"), "tight halt": replace(BASE, halt=0.03),
}


def days(t):
    types = t.universe.select("ticker", F.when(F.col("asset_type") == "etf", P.ETF_BPS).otherwise(P.USUAL_BPS).alias("bps"))
    gate = P.gates(vix(t), W.market_return(t.panel).select("date", F.lit(0).alias("state")))
    return P.strategy_days(shown(scores(t)), t.panel, types, BASE.top_k, BASE.lookback, gate)


@query("b16_b18_b20_backtest_variants")
def _(t):
    return shown(P.replay(days(t), VARIANTS))


_HEAD, _, _TAIL = CAL.rpartition("SELECT a.date")
SIZED = f"{_HEAD}SELECT date, ticker, round(CASE WHEN prob_cal IS NULL OR base_rate IS NULL THEN 1.0 ELSE least(1.0, greatest(0.0, (prob_cal - 0.5) / greatest(base_rate - 0.5, 1e-3::double))) END, 5) + 0.0 AS size_mult FROM (SELECT a.date{_TAIL})"


@query("b19_meta_sizing", SIZED, ["panel"])
def _(t):
    return shown(P.sized(shown(I.calibrated(probs(t))), "sized").select("date", "ticker", "size_mult"), digits=5)


@query("b21_eval_with_costs", shown_sql(f"SELECT d.date, sum(abs(delta)) * 7.5 / 1e4 AS cost FROM (SELECT date, ticker, coalesce(n.w, 0) - coalesce(o.w, 0) AS delta FROM (SELECT x.next AS date, ticker, w FROM ({TOP}) JOIN (SELECT date, lead(date) OVER (ORDER BY date) AS next FROM (SELECT DISTINCT date FROM panel)) x USING (date) WHERE x.next IS NOT NULL) o FULL JOIN ({TOP}) n USING (date, ticker)) d GROUP BY 1", ["date"], ["cost"]), ["panel"])
def _(t):
    return shown(changes(t).groupBy("date").agg((F.sum(F.abs("delta")) * 7.5 / 1e4).alias("cost")))


#: 2,000 draws of blocks of 21 sessions; the digest of seed, draw and place is the start of a block.
BOOT = f"""WITH d AS (SELECT ticker, ret - mkt AS d, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i FROM ({RET}) JOIN ({MKT}) USING (date) WHERE ret IS NOT NULL AND mkt IS NOT NULL),
 k AS (SELECT ticker, count(*) AS n, avg(d) AS mean_diff FROM d GROUP BY ticker HAVING count(*) >= 21),
 b AS (SELECT ticker, i, sum(d) OVER (PARTITION BY ticker ORDER BY i ROWS BETWEEN CURRENT ROW AND 20 FOLLOWING) AS s FROM d),
 g AS (SELECT ticker, list(s ORDER BY i) AS sums FROM b GROUP BY ticker),
 h AS (SELECT draw, j, ('0x' || substr(md5('42:' || draw || ':' || j), 1, 12))::BIGINT AS h FROM (SELECT unnest(range(2000)) AS draw), (SELECT unnest(range((SELECT max(n) FROM k) // 21 + 1)) AS j)),
 m AS (SELECT ticker, draw, sum(sums[h % (n - 20) + 1]) AS total FROM k JOIN g USING (ticker) JOIN h ON j < ceil(n / 21) GROUP BY ticker, draw)
 SELECT ticker, n, mean_diff, p_not_above FROM k JOIN (SELECT ticker, avg(CASE WHEN total <= 0 THEN 1.0 ELSE 0.0 END) AS p_not_above FROM m GROUP BY ticker) USING (ticker)"""


@query("a24b_block_bootstrap", shown_sql(BOOT, ["ticker", "n"], ["mean_diff", "p_not_above"]), ["panel"])
def _(t):
    return shown(I.bootstrap_diff(W.with_returns(t.panel).join(W.market_return(t.panel), "date").where("ret IS NOT NULL"), "ticker", "ret", "mkt"))


@query("x05_deflated_by_variant")
def _(t):
    return shown(A.deflated_sharpe(P.replay(days(t), VARIANTS), "net", "variant", trials=len(VARIANTS)))


FAMILY_COLUMNS = ["rev_ret_1d", "rev_ret_5d", "rev_z_5d", "cal_dow", "cal_month"]


@query("x01_p03_u04_feature_families", shown_sql(f"""SELECT date, ticker, rev_ret_1d, rev_ret_5d, rev_z_5d, cal_dow, cal_month, 'trend_sma50_gap' AS lacking FROM (
 SELECT date, ticker, ret AS rev_ret_1d, r5 AS rev_ret_5d, CASE WHEN count(r5) OVER w21 >= 15 THEN (r5 - avg(r5) OVER w21) / nullif(stddev_samp(r5) OVER w21, 0) END AS rev_z_5d, isodow(date) - 1 AS cal_dow, month(date) AS cal_month
 FROM (SELECT *, close / lag(close, 5) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r5 FROM ({RET})) WINDOW w21 AS (PARTITION BY ticker ORDER BY date ROWS 20 PRECEDING))""", ["date", "ticker", "cal_dow", "cal_month", "lacking"], FAMILY_COLUMNS[:3]), ["panel"])
def _(t):
    made = X1.with_prefix(X1.build(t.panel, t.macro, ["reversal", "calendar"]), ["rev_", "cal_dow", "cal_month"])
    lacking = X1.missing(made, [*FAMILY_COLUMNS, "trend_sma50_gap"])
    return shown(made.withColumn("lacking", F.lit(",".join(lacking))), "date", "ticker", *FAMILY_COLUMNS, "lacking")


@query("u05b_all_tickers", "SELECT DISTINCT ticker FROM (SELECT ticker FROM panel WHERE date < DATE '1996-01-01' UNION ALL SELECT ticker FROM membership)", ["panel", "membership"])
def _(t):
    return t.panel.where("date < date'1996-01-01'").select("ticker").unionByName(t.membership.select("ticker")).distinct()


#: Yearly versions of a model: the Sharpe ratio and mean return of the market in their year stand for their figures.
VERSIONS = f"SELECT version, CASE WHEN version <> 1997 THEN sharpe END AS sharpe, ic FROM (SELECT year(date) AS version, avg(mkt) / stddev_samp(mkt) AS sharpe, avg(mkt) AS ic FROM ({MKT}) WHERE mkt IS NOT NULL GROUP BY 1)"


def versions(t):
    f = W.market_return(t.panel).where("mkt IS NOT NULL").groupBy(F.year("date").alias("version"))
    return f.agg(F.when(F.col("version") != 1997, F.avg("mkt") / F.stddev_samp("mkt")).alias("sharpe"), F.avg("mkt").alias("ic"))


GATE = f"""WITH RECURSIVE v AS (SELECT *, row_number() OVER (ORDER BY version) AS n FROM ({VERSIONS})),
 g AS (SELECT n, version, version AS in_use, sharpe, ic FROM v WHERE n = 1
 UNION ALL SELECT v.n, v.version, CASE WHEN better THEN v.version ELSE in_use END, CASE WHEN better THEN v.sharpe ELSE g_sharpe END, CASE WHEN better THEN v.ic ELSE g_ic END
 FROM (SELECT v.*, g.in_use, g.sharpe AS g_sharpe, g.ic AS g_ic, CASE WHEN v.sharpe IS NOT NULL AND g.sharpe IS NOT NULL THEN v.sharpe > g.sharpe ELSE v.ic > g.ic END AS better FROM v JOIN g ON v.n = g.n + 1) v)
 SELECT version, in_use FROM g"""


@query("b10_promotion_gate", GATE, ["panel"])
def _(t):
    return K.promoted(versions(t))


@query("w12_registry", f"SELECT version, in_use AS current FROM ({GATE}) QUALIFY row_number() OVER (ORDER BY version DESC) = 1", ["panel"])
def _(t):
    """Every version is written to its own place, the pointer names the one in use, and the current one is loaded by it."""
    path = shared(t, "registry")
    versions(t).write.partitionBy("version").parquet(f"{path}/artifacts")
    saved = t.spark.read.parquet(f"{path}/artifacts")
    K.promoted(saved).agg(F.max_by("in_use", "version").alias("current"), F.max("version").alias("version")).write.parquet(f"{path}/pointer")
    pointer = t.spark.read.parquet(f"{path}/pointer")
    return pointer.join(saved.select(F.col("version").alias("current")), "current").select("version", "current")
