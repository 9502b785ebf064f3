"""Joins by time: as-of, interval, anti-range, and interval arithmetic.

An as-of join is a union of both sides and one running `last value` per key, so its cost is one
sort, whatever the gaps. Interval joins meet by key and by coarse time cells, so no key's rows are
all compared with all of its intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of(left: DataFrame, right: DataFrame, key: str, on: str, right_on: str, columns: list[str], ties: list[str] | None = None, strict: bool = True, forward: bool = False) -> DataFrame:
    """Each left row with the columns of the nearest right row of its key.

    Backward: the last one before (strict) or at its time; forward: the first one at or after
    (strict: after). Among right rows of one time, the last by `ties` counts.
    """
    ties = ties or []
    row = right.select(F.struct(*columns).alias("s")).schema["s"].dataType
    lefts = left.select(*left.columns, F.col(on).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(row).alias("_row"))
    rights = right.where(F.col(right_on).isNotNull()).select(key, F.col(right_on).alias("_at"), F.lit(1).alias("_kind"), F.struct(*columns).alias("_row"), *(F.col(c).alias(f"_tie{i}") for i, c in enumerate(ties)))
    both = lefts.unionByName(rights, allowMissingColumns=True)
    # Of one time, left rows come first where what is at their time must not be seen.
    at, kind = F.col("_at"), F.col("_kind")
    order = [at.desc() if forward else at.asc(), kind.asc() if strict else kind.desc(), *(F.col(f"_tie{i}") for i in range(len(ties)))]
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    made = both.withColumn("_row", F.last("_row", ignorenulls=True).over(w)).where("_kind = 0")
    return made.select(*left.columns, *(F.col(f"_row.{c}").alias(c if c not in left.columns else f"{c}_right") for c in columns))


def cells(date: Column, days: int = 64) -> Column:
    return F.floor(F.datediff(date, F.lit("1970-01-01").cast("date")) / days)


def interval_semi(rows: DataFrame, spans: DataFrame, key: str, at: str, days: int = 64) -> DataFrame:
    """Rows inside a span (start, end, both inclusive; no end: still open) of their key.

    A span is laid out over coarse cells of time, so a row meets only the spans of its own cell.
    """
    far = rows.agg(F.max(at)).first()[0]
    if far is None:  # no row has a time, so none lies in a span
        return rows.where(F.lit(False))
    last = F.coalesce(F.least("end", F.lit(far)), F.lit(far))
    laid = spans.where(F.col("start") <= F.lit(far)).withColumn("_cell", F.explode(F.sequence(cells(F.col("start"), days), F.greatest(cells(F.col("start"), days), cells(last, days)))))
    laid = laid.select(F.col(key).alias("_k"), "_cell", F.col("start").alias("_s"), F.col("end").alias("_e"))
    inside = (F.col(at) >= F.col("_s")) & (F.col("_e").isNull() | (F.col(at) <= F.col("_e")))
    return rows.withColumn("_c", cells(F.col(at), days)).join(laid, (F.col(key) == F.col("_k")) & (F.col("_c") == F.col("_cell")) & inside, "left_semi").drop("_c")


def members(rows: DataFrame, spans: DataFrame, key: str = "ticker", at: str = "date") -> DataFrame:
    """Rows inside a membership span, and all rows of keys without any span."""
    known = spans.select(key).distinct()
    return interval_semi(rows.join(known, key, "left_semi"), spans, key, at).unionByName(rows.join(known, key, "left_anti"))


def earnings_events(filings: DataFrame, before: int = 45, after: int = 7) -> DataFrame:
    """Announcements, and reports without an announcement in [filed - before, filed + after]."""
    primary = filings.where((F.col("form") == "8-K") & F.coalesce("items", F.lit("")).contains("2.02"))
    reports = filings.where(F.col("form").isin("10-Q", "10-K"))
    p = primary.select(F.col("ticker").alias("_k"), F.col("filed").alias("_f")).distinct()
    # An announcement is laid out over the cells of the days whose reports it stands for: a report meets those of its own cell.
    laid = p.select("_k", "_f", F.explode(F.sequence(cells(F.date_sub("_f", after)), cells(F.date_add("_f", before)))).alias("_cell"))
    near = F.col("_f").between(F.date_sub("filed", before), F.date_add("filed", after))
    apart = reports.withColumn("_c", cells(F.col("filed"))).join(laid, (F.col("ticker") == F.col("_k")) & (F.col("_c") == F.col("_cell")) & near, "left_anti")
    return primary.unionByName(apart.drop("_c"))


def merged_spans(spans: DataFrame, key: str = "ticker", gap: int = 7) -> DataFrame:
    """Spans of a key joined where they overlap or lie at most `gap` days apart; no end stays open."""
    w = Window.partitionBy(key).orderBy("start", "_to")
    s = spans.withColumn("_to", F.coalesce("end", F.lit("9999-12-31").cast("date")))
    s = s.withColumn("_reach", F.max("_to").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    s = s.withColumn("_new", F.when(F.col("_reach").isNull() | (F.datediff("start", "_reach") > gap), 1).otherwise(0))
    s = s.withColumn("_group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    made = s.groupBy(key, "_group").agg(F.min("start").alias("start"), F.max("_to").alias("_end"))
    return made.select(key, "start", F.when(F.col("_end") < F.lit("9999-12-31").cast("date"), F.col("_end")).alias("end"))


def overlap_days(spans: DataFrame, low: str, high: str, key: str = "ticker") -> DataFrame:
    """Days of each key's spans inside [low, high]."""
    a, b = F.lit(low).cast("date"), F.lit(high).cast("date")
    days = F.greatest(F.lit(0), F.datediff(F.least(F.coalesce("end", b), b), F.greatest("start", a)) + 1)
    return spans.groupBy(key).agg(F.sum(days).cast("long").alias("days"))


def aligned(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Two weight tables on the union of their keys, 0 where one has none, and the change."""
    a, b = left.select(*keys, F.col(value).alias("old")), right.select(*keys, F.col(value).alias("new"))
    both = a.join(b, keys, "full_outer").fillna(0.0, ["old", "new"])
    return both.withColumn("delta", F.col("new") - F.col("old"))


def new_names(incoming: DataFrame, existing: DataFrame, name: str = "name") -> DataFrame:
    """Incoming rows whose name, in any case, does not exist yet."""
    known = existing.select(F.lower(name).alias("_n")).distinct()
    return incoming.join(known, F.lower(name) == F.col("_n"), "left_anti")
