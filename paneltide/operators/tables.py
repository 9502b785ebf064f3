"""Keyed tables kept by rewriting: idempotent inserts, upserts, patches, cascades, slippage.

Each function returns the new table; what was there wins or loses by rule, never by arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paneltide.functions.text import looks_like_split


def append_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows, and new ones whose key is not there yet (of equal new keys, one)."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").dropDuplicates(keys).select(*old.columns))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """As append_missing, with the first new row by `order` for each key."""
    w = Window.partitionBy(*keys).orderBy(order)
    first = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of their key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*old.columns))


def patched(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Columns of the patch where it has a value; a NULL leaves the old one."""
    p = patch.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in patch.columns if c != key))
    made = base.join(p, key, "left")
    return made.select(*(F.coalesce(f"_{c}", c).alias(c) if c in patch.columns and c != key else F.col(c) for c in base.columns))


def without(parent: DataFrame, child: DataFrame, gone: DataFrame, key: str, foreign: str) -> tuple[DataFrame, DataFrame]:
    """Parent and child tables after rows of the parent, and what hangs on them, are deleted."""
    ids = gone.select(key).distinct()
    return parent.join(ids, key, "left_anti"), child.join(ids.withColumnRenamed(key, foreign), foreign, "left_anti").select(*child.columns)


def normal_name(name: Column) -> Column:
    """Lower case, single spaces, without a short code in brackets at the end."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(name, r"\s*\([A-Z0-9,\-\s]{1,30}\)\s*$", ""), r"\s+", " ")))


def new_companies(existing: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """Incoming companies that no existing one equals by normal name; of equal ones, the first."""
    w = Window.partitionBy("_key").orderBy(order)
    fresh = incoming.withColumn("_key", normal_name(F.col("name"))).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return fresh.join(existing.select(normal_name(F.col("name")).alias("_key")).distinct(), "_key", "left_anti").drop("_key", "_n")


def filled_status(signals: DataFrame, fills: DataFrame, key: str = "id") -> DataFrame:
    done = fills.select(key).distinct().withColumn("_f", F.lit(1))
    return signals.join(done, key, "left").withColumn("status", F.when(F.col("_f") == 1, "filled").otherwise(F.col("status"))).drop("_f")


def slippage(fills: DataFrame, orders: DataFrame, keys: list[str]) -> DataFrame:
    """Mean absolute slippage per month in basis points of the limit."""
    both = fills.join(orders, keys).where("limit_price > 0")
    bps = F.abs(F.col("price") - F.col("limit_price")) / F.col("limit_price") * 1e4
    return both.groupBy(F.date_format("fill_date", "yyyy-MM").alias("month")).agg(F.avg(bps).alias("realized_bps"), F.count("*").alias("n_fills"))


def outcomes(log: DataFrame, closes: DataFrame, column: str) -> DataFrame:
    """Fills an outcome column where it is still NULL."""
    return log.join(closes.withColumnRenamed(column, "_o"), ["ticker", "date"], "left").withColumn(column, F.coalesce(column, "_o")).drop("_o")


def table_hash(df: DataFrame, columns: list[str], digits: int = 8) -> DataFrame:
    """Row count and an order-free digest of the columns, doubles rounded."""
    kinds = dict(df.dtypes)
    cols = [F.round(c, digits) if kinds[c] in ("double", "float") else F.col(c) for c in columns]
    return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).cast("string").alias("digest"))


def ticket(lines: DataFrame) -> DataFrame:
    """One markdown table per date, lines in order of rank."""
    row = F.format_string("| %d | %s | %.2f | %s |", F.col("rank"), F.col("ticker"), F.col("weight"), F.col("side"))
    held = F.array_sort(F.collect_list(F.struct("rank", row.alias("text"))))
    return lines.groupBy("date").agg(F.concat(F.lit("| rank | ticker | weight | side |\n"), F.array_join(held.getField("text"), "\n")).alias("markdown"))


def limit_price(close: Column, side: Column) -> Column:
    """A little through the close, in whole cents, halves away from zero."""
    exact = close.cast("decimal(18,6)")
    return F.round(F.when(side == "BUY", exact * F.lit("1.002").cast("decimal(6,3)")).otherwise(exact * F.lit("0.998").cast("decimal(6,3)")), 2).cast("decimal(18,2)")


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the last in order."""
    newest = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def series_checks(panel: DataFrame, least: int = 260, move: float = 0.40, most: int = 8, gap: int = 7) -> DataFrame:
    """Per ticker: rows, faults and whether the series is usable.

    Large moves over a gap in the listing do not count; one at the ratio of a split, or `most` of
    any kind, make a series unusable. panel holds one row per ticker and date (see keep_last).
    """
    w = Window.partitionBy("ticker").orderBy("date")
    ratio = F.col("close") / F.nullif(F.lag("close").over(w), F.lit(0.0))
    near = F.datediff("date", F.lag("date").over(w)) <= gap
    jump = (F.abs(ratio - 1) > move) & near
    rows = panel.select(
        "ticker", (F.least("open", "high", "low", "close") <= 0).alias("bad"), (F.col("high") < F.col("low")).alias("crossed"),
        jump.alias("jump"), (jump & looks_like_split(ratio)).alias("split"),
    )
    n = lambda c: F.count(F.when(F.col(c), 1))
    made = rows.groupBy("ticker").agg(F.count("*").alias("n"), n("bad").alias("bad"), n("crossed").alias("crossed"), n("jump").alias("jumps"), n("split").alias("splits"))
    ok = (F.col("n") >= least) & (F.col("bad") == 0) & (F.col("crossed") == 0) & (F.col("splits") == 0) & (F.col("jumps") < most)
    return made.withColumn("ok", ok)


def surviving(checks: DataFrame, least_share: float = 0.5) -> DataFrame:
    """The usable tickers; an error where fewer than this share are. One row is brought to the driver."""
    n, usable = checks.agg(F.count("*"), F.count(F.when(F.col("ok"), 1))).first()
    if usable < least_share * n:
        raise ValueError(f"only {usable} of {n} series are usable")
    return checks.where("ok").select("ticker")


def promoted(candidates: DataFrame, key: str = "version") -> DataFrame:
    """Candidates in order of version, each with the version in use after it.

    A candidate takes over where its `sharpe` is above that of the one in use; where either has none,
    where its `ic` is; the first always does. One short row per version, folded in order.
    """
    row = F.struct(key, "sharpe", "ic")
    past = F.array_sort(F.collect_list(row).over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)))

    def later(best: Column, x: Column) -> Column:
        both = x["sharpe"].isNotNull() & best["sharpe"].isNotNull()
        better = F.when(both, x["sharpe"] > best["sharpe"]).otherwise(best["ic"].isNull() | (x["ic"] > best["ic"]))
        return F.when(F.coalesce(better, F.lit(False)), x).otherwise(best)

    current = F.aggregate(F.slice(past, F.lit(2), F.size(past) - 1), past[0], later)
    return candidates.select(key, current[key].alias("in_use"))


#: Fixed texts of a ticket.
DISCLAIMER = (
    "> Research decision-support output, not investment advice. Signals are model rankings with substantial uncertainty; losses are "
    "possible and expected in some periods. Execute manually only if you accept the risks."
)
NO_TRADES = "*No trades today — targets unchanged within the minimum-trade band.*"
TICKET_HEAD = "| # | Action | Ticker | Shares | Limit | Last close | Target wt | Score |\n|---|--------|--------|--------|-------|------------|-----------|-------|"


def ticket_lines(changes: DataFrame, scores: DataFrame, closes: DataFrame, capital: float) -> DataFrame:
    """What to trade on each date: rank, action, shares and limit of each name that is or was held.

    changes: date, ticker, old and new weights; scores: date, ticker, score; closes: date, ticker, close. A name without a
    score ranks with the lowest of its date; one without a close, or too small for one share, has no line.
    """
    day = Window.partitionBy("date")
    lowest = scores.groupBy("date").agg(F.min("score").alias("_low"))
    known = changes.join(scores, ["date", "ticker"], "left").join(lowest, "date", "left")
    known = known.withColumn("_s", F.coalesce("score", "_low", F.lit(0.0)))
    # The mean place of equal scores, cut to a whole number.
    first, same = F.rank().over(day.orderBy(F.col("_s").desc())), F.count("*").over(Window.partitionBy("date", "_s"))
    ranked = known.withColumn("rank", F.floor(first + (same - 1) / 2).cast("long"))
    delta = F.col("new") - F.col("old")
    action = F.when(F.abs(delta) < 1e-9, "hold").when(delta > 0, "buy").otherwise("sell")
    shares = F.floor(F.abs(delta) * capital / F.col("close")).cast("long")
    made = ranked.join(closes.where("close IS NOT NULL"), ["date", "ticker"]).withColumns({"action": action, "_n": shares})
    made = made.where(~((F.col("_n") == 0) & (F.abs(delta) > 0)) & ~((F.col("action") == "hold") & (F.col("new") == 0)))
    limit = limit_price(F.round("close", 6), F.when(F.col("action") == "buy", "BUY").otherwise("SELL"))
    return made.select(
        "date", "ticker", "score", "rank", F.col("new").alias("weight"), F.when(F.col("action") == "hold", 0).otherwise(F.col("_n")).alias("shares"),
        limit.alias("limit_price"), F.col("close").alias("last_close"), "action",
    )


def whole_tickets(days: DataFrame, lines: DataFrame, capital: float, mode: str, title: str) -> DataFrame:
    """date and markdown of each date of `days`, with its gates' notes and, where a rule stood in for the model, why.

    days: date, notes (array), fallback_mode, reason.
    """
    dash = F.lit("—")
    row = F.format_string(
        "| %d | %s | %s | %s | $%s | $%,.2f | %.1f%% | %s |", F.col("rank"), F.upper("action"), F.col("ticker"),
        F.when(F.col("shares") == 0, dash).otherwise(F.col("shares").cast("string")), F.col("limit_price").cast("string"),
        F.round("last_close", 2), F.round(F.col("weight") * 100, 1), F.coalesce(F.format_string("%+.4f", F.round("score", 4)), F.lit("+nan")),
    )
    told = lines.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("rank", "ticker", row.alias("text")))).getField("text").alias("rows"))
    all_days = days.join(told, "date", "left")
    banner = F.when(F.col("fallback_mode"), F.concat(F.lit("  |  **FALLBACK MODE** — "), "reason")).otherwise("")
    notes = F.when(
        F.size(F.coalesce("notes", F.array().cast("array<string>"))) > 0,
        F.concat(F.lit("## Gates\n- "), F.array_join("notes", "\n- "), F.lit("\n\n")),
    ).otherwise("")
    body = F.when(F.col("rows").isNull(), NO_TRADES).otherwise(F.concat(F.lit(TICKET_HEAD + "\n"), F.array_join("rows", "\n")))
    return all_days.select("date", F.concat(
        F.lit(f"# {title} — Trade Ticket for "), F.col("date").cast("string"), F.lit(f"\n\nMode: **{mode}**"), banner,
        F.lit(f"\nSizing basis: ${capital:,.0f} (paper)\n\n"), notes, body, F.lit(f"\n\n{DISCLAIMER}\n"),
    ).alias("markdown"))
