"""Weights of picked names, the gates before a rebalance, and the replay of a strategy.

Returns are aligned by session: a session on which a name did not trade counts as no change.
What reaches Python is a date's picks, or rows in order of date with their picks and the moves of
names that were picked by then, a batch at a time; never the panel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paneltide.operators.iterative import sessions
from paneltide.operators.windows import YEAR, by_ticker, over, rolled, with_returns

#: Costs of one side of a trade, in basis points, by type of asset.
USUAL_BPS, ETF_BPS = 7.5, 3.0
#: Least sessions that a covariance is taken from.
LEAST_SESSIONS = 40
#: Most moves of a row that is walked: a batch of rows has a size that does not grow with the names picked by then.
PART = 128


def rolled_vol(panel: DataFrame) -> DataFrame:
    return with_returns(panel).withColumn("vol", rolled(F.stddev_samp, F.col("ret"), 63, LEAST_SESSIONS) * YEAR**0.5)


# ------------------------------------------------------------------ weights


def capped(shares: np.ndarray, cap: float) -> np.ndarray:
    """Weights that add up to one, in proportion to the shares but none above the cap.

    Largest first, there is one number m of names at the cap for which the others, scaled to what is
    left, stay below it. If no m fits, every name with a share is at the cap and the rest is cash.
    """
    shares = np.maximum(np.asarray(shares, float), 0.0)
    order = np.argsort(-shares, kind="stable")
    ranked = shares[order]
    behind = np.cumsum(ranked[::-1])[::-1]
    if not len(shares) or behind[0] <= 0:
        return shares
    left = 1.0 - cap * np.arange(len(shares))
    level = left / np.where(behind > 0, behind, 1.0)
    fits = np.flatnonzero((behind > 0) & (ranked * level <= cap + 1e-12))
    return np.minimum(shares * level[fits[0]], cap) if len(fits) else np.where(shares > 0, cap, 0.0)


def inverse_volatility(rows: DataFrame, cap: float) -> DataFrame:
    """rows: date, ticker, vol of the picks -> capped weights in proportion to 1/vol (see capped)."""
    order = [F.col("share").desc(), F.col("ticker")]
    ranked = rows.withColumn("share", 1 / F.greatest(F.col("vol"), F.lit(1e-6)))
    day = Window.partitionBy("date").orderBy(*order)
    behind = F.sum("share").over(day.rowsBetween(0, Window.unboundedFollowing))
    level = (1 - F.lit(cap) * (F.row_number().over(day) - 1)) / behind
    marked = ranked.withColumn("level", level).withColumn("n", F.row_number().over(day))
    fits = F.when(F.col("share") * F.col("level") <= cap + 1e-12, F.struct("n", "level"))
    first = F.min(fits).over(Window.partitionBy("date"))["level"]
    return marked.select("date", "ticker", F.least(F.lit(cap), F.coalesce(F.col("share") * first, F.lit(cap))).alias("weight"))


def risk_parity(returns: np.ndarray) -> np.ndarray:
    """Hierarchical risk parity: names in the order of a single-linkage tree, halves weighted against their variance.

    A merged cluster lists the older of its two parts first, parts being numbered as they arise.
    """
    n = returns.shape[1]
    if n == 1:
        return np.ones(1)
    corr, sd = correlations(returns)
    cov = corr * np.outer(sd, sd)
    far = np.sqrt(0.5 * (1 - np.clip(corr, -1, 1)))
    # A minimum spanning tree holds all merges of single linkage.
    near, via, inside, edges = far[0].copy(), np.zeros(n, int), np.arange(n) == 0, []
    for _ in range(n - 1):
        j = int(np.argmin(np.where(inside, np.inf, near)))
        edges.append((near[j], via[j], j))
        inside[j] = True
        closer = far[j] < near
        near, via = np.where(closer, far[j], near), np.where(closer, j, via)
    part_of, leaves = list(range(n)), {i: [i] for i in range(n)}
    for k, (_, i, j) in enumerate(sorted(edges, key=lambda e: e[0])):
        a, b = sorted((part_of[i], part_of[j]))
        leaves[n + k] = leaves.pop(a) + leaves.pop(b)
        for x in leaves[n + k]:
            part_of[x] = n + k
    order, weights = leaves[2 * n - 2], np.ones(n)

    def risk(names: list[int]) -> float:
        q = 1 / np.diag(cov)[names]
        q /= q.sum()
        return float(q @ cov[np.ix_(names, names)] @ q)

    def share_out(names: list[int]) -> None:
        if len(names) > 1:
            halves = names[: len(names) // 2], names[len(names) // 2 :]
            low, high = map(risk, halves)
            weights[halves[0]] *= high / (low + high)
            weights[halves[1]] *= low / (low + high)
            for half in halves:
                share_out(half)

    share_out(order)
    return weights / weights.sum()


def correlations(returns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Correlation matrix (0 where a name does not vary) and deviations (the mean one in place of 0)."""
    centred = returns - returns.mean(axis=0)
    sd = np.sqrt((centred**2).sum(axis=0) / (len(returns) - 1))
    unit = np.divide(centred, sd, out=np.zeros_like(centred), where=sd > 0)
    corr = unit.T @ unit / (len(returns) - 1)
    np.fill_diagonal(corr, 1.0)
    return corr, np.where(sd > 0, sd, sd.mean() or 1e-6)


def cleaned_min_variance(returns: np.ndarray) -> np.ndarray:
    """Long-only least variance; eigenvalues below the edge of pure noise are set to their mean."""
    n = returns.shape[1]
    if n == 1:
        return np.ones(1)
    corr, _ = correlations(returns)
    sd = returns.std(axis=0, ddof=1)
    sd = np.where(sd > 0, sd, 1e-6)
    values, vectors = np.linalg.eigh(corr)
    noise = values < (1 + np.sqrt(n / len(returns))) ** 2
    values = np.where(noise, values[noise].mean() if noise.any() else 0.0, values)
    clean = (vectors * values) @ vectors.T
    scale = sd / np.sqrt(np.diag(clean))  # from the cleaned matrix to the covariance
    weights = np.linalg.lstsq(clean * np.outer(scale, scale), np.ones(n), rcond=1e-15)[0]
    weights = np.maximum(weights, 0.0)
    return weights / weights.sum() if weights.sum() > 0 else np.full(n, 1 / n)


SCHEMES = {"hrp": risk_parity, "rmt_minvar": cleaned_min_variance}


def with_past(picks: DataFrame, panel: DataFrame, lookback: int) -> DataFrame:
    """picks (date, ticker, ...) with `past`: returns of that session and those before it, oldest first.

    Only the picks' own sessions are fetched, by an equal join; sessions before the calendar are left out.
    """
    numbered = F.broadcast(sessions(panel))  # one row per date
    returns = with_returns(panel).join(numbered, "date").select("ticker", F.col("idx").alias("s"), "ret")
    wanted = picks.select("date", "ticker").join(numbered, "date")
    wanted = wanted.withColumn("s", F.explode(F.sequence(F.greatest(F.lit(0), F.col("idx") - (lookback - 1)), F.col("idx"))))
    each = F.struct("s", F.coalesce("ret", F.lit(0.0)).alias("ret"))
    held = wanted.join(returns, ["ticker", "s"], "left").groupBy("date", "ticker").agg(F.array_sort(F.collect_list(each))["ret"].alias("past"))
    return picks.join(held, ["date", "ticker"])


def scheme_weights(panel: DataFrame, picks: DataFrame, scheme: str, cap: float = 0.4, lookback: int = 64) -> DataFrame:
    """Weights of each date's picks (date, ticker) from their last returns, by a named scheme; one small group a date."""

    def weigh(day: pd.DataFrame) -> pd.DataFrame:
        day = day.sort_values("ticker")
        weights = capped(SCHEMES[scheme](np.column_stack(day.past.to_numpy())), cap)
        return pd.DataFrame({"date": day.date, "ticker": day.ticker, "weight": weights})

    enough = with_past(picks, panel, lookback).where(F.size("past") >= LEAST_SESSIONS)
    return enough.groupBy("date").applyInPandas(weigh, "date date, ticker string, weight double")


def vol_target(weights: DataFrame, panel: DataFrame, target: float, lookback: int = 63) -> DataFrame:
    """Scale of at most 1 per date that brings the volatility of today's book over past sessions to a target."""
    rows = with_past(weights, panel, lookback).select("date", "weight", F.posexplode("past").alias("k", "r"))
    book = rows.groupBy("date", "k").agg(F.sum(F.col("weight") * F.col("r")).alias("r"))
    vol = book.groupBy("date").agg((F.stddev_samp("r") * YEAR**0.5).alias("vol"))
    return vol.select("date", "vol", F.when(F.col("vol") > 0, F.least(F.lit(1.0), F.lit(target) / F.col("vol"))).otherwise(1.0).alias("scale"))


def trade_band(target: DataFrame, previous: DataFrame, band: float) -> DataFrame:
    """Keeps the old weight where the change is under the band; only positive weights stay."""
    new, old = (x.select("date", "ticker", F.col("weight").alias(n)) for x, n in ((target, "new"), (previous, "old")))
    both = new.join(old, ["date", "ticker"], "full_outer").fillna(0.0, ["new", "old"])
    kept = F.when(F.abs(F.col("new") - F.col("old")) < band, F.col("old")).otherwise(F.col("new"))
    return both.select("date", "ticker", kept.alias("weight")).where("weight > 0")


# -------------------------------------------------------------------- gates


def gates(vix: DataFrame, states: DataFrame, equity: DataFrame | None = None, halt: float = 0.10) -> DataFrame:
    """Per date: exposure, whether new names may enter, and why.

    vix: date, vix, vix3m; states: date, state (1: stress); equity: date, equity, high_water_mark.
    """
    both = vix.join(states, "date", "full_outer")
    if equity is not None:
        both = both.join(equity, "date", "full_outer")
    inverted = over(F.col("vix3m"), F.when(F.col("vix") > 0, F.col("vix"))) < 1
    stress = F.col("state") == 1
    deep = over(F.col("equity"), F.when(F.col("high_water_mark") > 0, F.col("high_water_mark"))) - 1 <= -halt if equity is not None else F.lit(None).cast("boolean")
    none = F.lit(None).cast("string")
    no_vix = F.col("vix").isNull() | F.col("vix3m").isNull() | (F.col("vix") <= 0)
    notes = F.array(
        F.when(no_vix, "VIX gate INACTIVE").when(inverted, "VIX term structure inverted").otherwise(none),
        F.when(F.col("state").isNull(), "jump-model gate INACTIVE").when(stress, "jump model: STRESS").otherwise(none),
        F.when(deep, "drawdown circuit breaker").otherwise(none),
    )
    half = lambda c: F.when(c, 0.5).otherwise(1.0)
    shut = lambda c: F.coalesce(c, F.lit(False))
    return both.select(
        "date", (half(inverted) * half(stress)).alias("exposure_scale"),
        (~(shut(inverted) | shut(stress) | shut(deep))).alias("allow_new_entries"), F.array_join(F.array_compact(notes), "; ").alias("notes"),
    )


def earnings_exclusions(days: DataFrame, earnings: DataFrame, ahead: int = 2) -> DataFrame:
    """(date, ticker) of names that report on the date or on one of the next `ahead` sessions.

    days: the calendar (date); earnings: ticker, earnings_date.
    """
    w = Window.orderBy("date")  # one row per date
    near = days.select("date").distinct().withColumn("near", F.array("date", *(F.lead("date", k).over(w) for k in range(1, ahead + 1))))
    near = near.select("date", F.explode("near").alias("earnings_date"))
    return earnings.select("ticker", F.to_date("earnings_date").alias("earnings_date")).join(near, "earnings_date").select("date", "ticker").distinct()


def decisions(
    days: DataFrame, earnings: DataFrame, vix: DataFrame, states: DataFrame, equity: DataFrame, ahead: int = 2, halt: float = 0.10
) -> DataFrame:
    """All gates of each date: names left out, exposure, whether new names may enter, and the notes in order.

    days: date; earnings: ticker, earnings_date; vix: date, vix, vix3m; states: date, state; equity: date, equity, high_water_mark.
    Without any earnings date the first gate says that it is inactive, on every date.
    """
    calendar = days.select("date").distinct()
    excluded = earnings_exclusions(calendar, earnings, ahead).groupBy("date").agg(F.array_sort(F.collect_set("ticker")).alias("_out"))
    known = earnings.where("earnings_date IS NOT NULL").agg(F.count("*").alias("n"))
    made = calendar.join(excluded, "date", "left").withColumn("_known", known.scalar())
    for other in (vix, states, equity):
        made = made.join(other, "date", "left")
    ratio = over(F.col("vix3m"), F.when(F.col("vix") > 0, F.col("vix")))
    deep = over(F.col("equity"), F.when(F.col("high_water_mark") > 0, F.col("high_water_mark"))) - 1
    inverted, stress, halted = (F.coalesce(c, F.lit(False)) for c in (ratio < 1, F.col("state") == 1, deep <= -halt))
    names = F.concat(F.lit("['"), F.array_join("_out", "', '"), F.lit("']"))
    notes = F.array_compact(F.array(
        F.when(F.col("_known") == 0, "earnings gate INACTIVE (no earnings calendar)")
        .when(F.col("_out").isNotNull(), F.concat(F.lit("earnings exclusion: "), names)),
        F.when(ratio.isNull(), "VIX gate INACTIVE (missing VIX/VIX3M data)").when(
            inverted, F.format_string("VIX term structure inverted (VIX3M/VIX=%.2f) — exposure halved, no new entries", F.round(ratio, 2))
        ),
        F.when(F.col("state").isNull(), "jump-model gate INACTIVE (no regime state available)").when(
            stress, "jump model: STRESS regime — exposure halved, no new entries"
        ),
        F.when(halted, F.format_string("drawdown circuit breaker: %.1f%% from HWM — new entries halted", F.round(deep * 100, 1))),
    ))
    half = lambda c: F.when(c, 0.5).otherwise(1.0)
    return made.select(
        "date", F.coalesce("_out", F.array().cast("array<string>")).alias("excluded"), (half(inverted) * half(stress)).alias("exposure_scale"),
        (~(inverted | stress | halted)).alias("allow_new_entries"), notes.alias("notes"),
    )


# ------------------------------------------------------------------- sizing


def bet_size(prob: str, base: str) -> Column:
    """Conviction between 0 and 1 by how far a probability lies above one half; NULL where one of both is."""
    known = F.col(prob).isNotNull() & F.col(base).isNotNull()  # greatest() passes over a NULL
    return F.when(known, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(prob) - 0.5) / F.greatest(F.col(base) - 0.5, F.lit(1e-3)))))


def size_of(mode: str, threshold: float = 0.5) -> Column:
    """Multiplier of a bet by mode: off, tilt, gate or sized; NULL is neutral."""
    made = {
        "off": F.lit(1.0), "tilt": F.col("prob"), "gate": F.when(F.col("prob") >= threshold, 1.0).when(F.col("prob").isNotNull(), 0.0),
        "sized": bet_size("prob_cal", "base_rate"),
    }[mode]
    return F.coalesce(made, F.lit(1.0))


def sized(df: DataFrame, mode: str, threshold: float = 0.5) -> DataFrame:
    """Multiplier of each bet by mode (see size_of)."""
    return df.withColumn("size_mult", size_of(mode, threshold))


# ------------------------------------------------------------------- replay


@dataclass(frozen=True)
class Strategy:
    """What a strategy does at a rebalance; the names of fields are those of its parameters."""

    top_k: int = 12
    max_weight: float = 0.10
    vol_target: float = 0.12
    lookback: int = 63
    band: float = 0.01
    every: int = 1
    halt: float = 0.10
    weighting: str = "inverse_vol"
    renormalise: bool = False  # after the bets' multipliers


def strategy_days(scores: DataFrame, panel: DataFrame, bps: DataFrame, top_k: int, lookback: int, gate: DataFrame | None = None, mult: DataFrame | None = None) -> DataFrame:
    """One row per date with scores that has a next session: the picks, best first, and the next moves of names picked by then.

    scores: date, ticker, score; bps: ticker, bps; gate: date, exposure_scale, allow_new_entries; mult: date, ticker, mults
    (a map from the name of a variant to its multiplier).
    """
    numbered = sessions(panel)
    days = numbered.withColumn("next_date", F.lead("date").over(Window.orderBy("date"))).where("next_date IS NOT NULL")
    usable = scores.where("score IS NOT NULL").join(rolled_vol(panel).select("date", "ticker", "vol"), ["date", "ticker"]).where("vol IS NOT NULL")
    best = Window.partitionBy("date").orderBy(F.col("score").desc(), "ticker")
    top = usable.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k).drop("score")
    top = with_past(top, panel, lookback + 1).join(bps, "ticker", "left")
    top = top.join(mult, ["date", "ticker"], "left") if mult is not None else top.withColumn("mults", F.lit(None).cast("map<string, double>"))
    each = F.struct("rank", "ticker", "vol", F.coalesce("bps", F.lit(USUAL_BPS)).alias("bps"), "past", "mults")
    picks = top.groupBy("date").agg(F.array_sort(F.collect_list(each), lambda a, b: a["rank"] - b["rank"]).alias("picks"))
    since = top.groupBy("ticker").agg(F.min("date").alias("since"))  # nothing is held before its first pick
    after = with_returns(panel).join(since, "ticker").where(F.col("date") > F.col("since")).select(F.col("date").alias("next_date"), "ticker", "ret")
    moves = after.where("ret IS NOT NULL").groupBy("next_date").agg(F.collect_list(F.struct("ticker", "ret")).alias("moves"))
    made = scores.select("date").distinct().join(F.broadcast(days), "date").join(picks, "date", "left").join(moves, "next_date", "left")
    if gate is not None:
        made = made.join(gate, "date", "left")
    else:
        made = made.withColumns({"exposure_scale": F.lit(1.0), "allow_new_entries": F.lit(True)})
    return made.select(
        F.col("idx").cast("long").alias("session"), "next_date", F.coalesce("exposure_scale", F.lit(1.0)).alias("exposure"),
        F.coalesce("allow_new_entries", F.lit(True)).alias("entries"), "picks", "moves",
    )


def replay(days: DataFrame, variants: dict[str, Strategy]) -> DataFrame:
    """Walks each variant through the same days, one row per date (see strategy_days), in order and a batch at a time.

    Weights set on a date earn the return to the next session, trades pay their side's cost, and what
    is held drifts with prices until the next rebalance. New names stay out while the book is `halt`
    below the highest of its last 252 marks.
    """
    named = by_parts(days).withColumn("name", F.explode(F.array(*map(F.lit, variants))))
    mult = lambda p: p.withField("mult", F.try_element_at(p["mults"], F.col("name"))).dropFields("mults")  # noqa: E731  (the variant's)
    named = named.withColumn("picks", F.transform("picks", mult))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = day = None  # a day's parts may lie in several batches: it is closed when the next one begins

        def closed() -> tuple:
            nonlocal held, marks
            gains = target * got
            gross = float(gains.sum())
            marks = [*marks[-YEAR:], marks[-1] * (1 + gross - cost)]
            held = (target + gains) / (1 + gross) if gross > -1 else held.iloc[:0]
            return name, day, gross, gross - cost, cost, float(traded.sum()), marks[-1]

        def told(out: list) -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["variant", "date", "gross", "net", "cost", "turnover", "equity"])

        for batch in batches:
            columns, out = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}, []
            starts = np.union1d(np.flatnonzero(columns["part"].to_numpy() == 0), [0] * (batch.num_rows > 0)).astype(int).tolist()
            for k, end in zip(starts, [*starts[1:], batch.num_rows]):
                if columns["part"][k].as_py() == 0:
                    if day is not None:
                        out.append(closed())
                    if columns["name"][k].as_py() != name:
                        name = columns["name"][k].as_py()
                        plan, held, costs, marks, due = variants[name], pd.Series(dtype=float), {}, [1.0], 0
                    day, target = columns["next_date"][k].as_py(), held
                    if due == 0:
                        picks = columns["picks"][k].as_py() or []
                        if not columns["entries"][k].as_py() or marks[-1] / max(marks[-YEAR:]) - 1 <= -plan.halt:
                            picks = [p for p in picks if held.get(p["ticker"], 0.0) > 0]
                        costs |= {p["ticker"]: p["bps"] for p in picks}
                        target = rebalanced(picks, held, columns["exposure"][k].as_py(), plan)
                    due = (due or plan.every) - 1
                    traded = target.sub(held, fill_value=0.0).abs()
                    cost = float((traded * traded.index.map(lambda t: costs.get(t, USUAL_BPS))).sum()) / 1e4 if len(traded) else 0.0
                    got = np.zeros(len(target))
                got += moved(columns["moves"].slice(k, end - k).flatten(), target.index)
            yield from told(out)
        if day is not None:
            yield from told([closed()])

    walked = named.repartition(len(variants), "name").sortWithinPartitions("name", "session", "part")
    return walked.mapInArrow(walk, "variant string, date date, gross double, net double, cost double, turnover double, equity double")


def by_parts(days: DataFrame) -> DataFrame:
    """Each date's row as parts of at most PART moves, numbered from 0; the first one holds the picks."""
    last = F.greatest(F.lit(0).cast("long"), F.floor((F.coalesce(F.size("moves"), F.lit(0)) - 1) / PART))
    parts = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: F.struct(i.alias("part"), F.slice("moves", (i * PART + 1).cast("int"), PART).alias("moves")))
    laid = days.select(*(c for c in days.columns if c != "moves"), F.inline(parts))
    return laid.withColumn("picks", F.when(F.col("part") == 0, F.col("picks")))


def moved(moves: pa.StructArray, names: pd.Index) -> np.ndarray:
    """Returns of names, looked up in a day's moves as they lie in the batch; 0 where there is none."""
    if not len(moves) or not len(names):
        return np.zeros(len(names))
    at = pc.index_in(pa.array(names, pa.string()), value_set=moves.field("ticker"))
    return moves.field("ret").take(at).fill_null(0.0).to_numpy(zero_copy_only=False)


def rebalanced(picks: list, held: pd.Series, exposure: float, plan: Strategy) -> pd.Series:
    """Target weights of the picks: shares, bets, volatility and exposure, and no trade under the band."""
    if not picks:
        return pd.Series(dtype=float)
    past = np.column_stack([p["past"] for p in picks])
    if plan.weighting in SCHEMES and len(picks) > 1 and len(past) >= LEAST_SESSIONS:
        weights = capped(SCHEMES[plan.weighting](past), plan.max_weight)
    else:
        weights = capped(1 / np.maximum([p["vol"] for p in picks], 1e-6), plan.max_weight)
    bets = np.array([1.0 if p["mult"] is None or p["mult"] != p["mult"] else p["mult"] for p in picks]).clip(0, 1)
    weights = capped(weights * bets, plan.max_weight) if plan.renormalise else weights * bets
    spread = (past @ weights)[-plan.lookback :].std(ddof=1) * YEAR**0.5
    scale = exposure * (min(1.0, plan.vol_target / spread) if spread > 0 else 1.0)
    target = pd.Series(weights * scale, [p["ticker"] for p in picks])
    target, old = target[weights > 0].align(held, fill_value=0.0)
    target = target.where((target - old).abs() >= plan.band, old)
    return target[target > 0]
