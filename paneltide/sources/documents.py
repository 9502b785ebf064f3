"""Rows straight from documents that are held as text: nested facts, arrays per column, feeds, and sessions of spans.

A document is unfolded where it lies, by table functions that are joined to its own row; nothing is gathered by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paneltide.sources.files import plain_text, signal_kind

ENTRY = "struct<title: string, link: array<struct<_href: string, _rel: string>>, summary: string, content: string, published: string, updated: string>"


def facts_of(docs: DataFrame, column: str = "json", since: str | None = None) -> DataFrame:
    """One row per reported value: ticker, taxonomy, tag, unit, start, end, filed, form, val.

    docs: ticker, and text like {"facts": {taxonomy: {tag: {"units": {unit: [{"end": .., "val": ..}, ..]}}}}}. Text that is no
    JSON, and values without an end, a filing date or a number, give no rows; of equal ones all stay.
    """
    spark = docs.sparkSession
    root = docs.select("ticker", F.try_parse_json(F.col(column)).alias("_v"))
    opened = root.select("ticker", F.try_variant_get("_v", "$.facts", "variant").alias("_v"))
    for name in ("taxonomy", "tag"):
        inner = F.try_variant_get(F.col("value"), "$.units", "variant") if name == "tag" else F.col("value")
        kept = [c for c in opened.columns if c != "_v"]
        opened = opened.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer())).select(*kept, F.col("key").alias(name), inner.alias("_v"))
    kept = [c for c in opened.columns if c != "_v"]
    units = opened.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer())).select(*kept, F.col("key").alias("unit"), F.col("value").alias("_v"))
    rows = units.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer())).select(*kept, "unit", F.col("value").alias("_r"))
    date = lambda c: F.try_variant_get("_r", f"$.{c}", "date").alias(c)
    made = rows.select(
        *kept, "unit", date("start"), date("end"), date("filed"), F.try_variant_get("_r", "$.form", "string").alias("form"),
        F.try_variant_get("_r", "$.val", "double").alias("val"),
    ).where("`end` IS NOT NULL AND filed IS NOT NULL AND val IS NOT NULL")
    return made if since is None else made.where(F.col("end") >= F.lit(since).cast("date"))


def filings_of(docs: DataFrame, fields: dict[str, str], path: str = "$.filings.recent", column: str = "json") -> DataFrame:
    """Rows of a table that a document writes as one array per column: ticker and the fields, by name and type.

    A column that is missing, or shorter than the others, gives NULL.
    """
    root = docs.select("ticker", F.try_parse_json(F.col(column)).alias("_v"))
    arrays = root.select("ticker", *(F.try_variant_get("_v", f"{path}.{c}", f"array<{kind}>").alias(c) for c, kind in fields.items()))
    return arrays.select("ticker", F.explode(F.arrays_zip(*fields)).alias("_r")).select("ticker", *(F.col(f"_r.{c}") for c in fields))


def sessions_of(spans: DataFrame, calendar: DataFrame) -> DataFrame:
    """The spans (start, end, both included; an open end is the last session) once for each session in them, as `date`.

    Each bound finds its place in the calendar, and the places between are unfolded; a span meets only its own sessions.
    """
    numbered = calendar.select("date").distinct().withColumn("_n", F.row_number().over(Window.orderBy("date")))  # one row per date
    bounds = spans.select(F.explode(F.array("start", F.coalesce("end", F.lit("9999-12-31").cast("date")))).alias("_at")).distinct().where("_at IS NOT NULL")
    both = numbered.select(F.col("date").alias("_at"), "_n").unionByName(bounds.select("_at", F.lit(None).cast("int").alias("_n")))
    at_or_before = Window.orderBy("_at", F.col("_n").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_at", F.col("_n").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    placed = both.select("_at", F.col("_n").alias("_own"), F.last("_n", ignorenulls=True).over(at_or_before).alias("_last"), F.last("_n", ignorenulls=True).over(before).alias("_before"))
    placed = placed.where("_own IS NULL").select("_at", F.coalesce("_last", F.lit(0)).alias("_last"), (F.coalesce("_before", F.lit(0)) + 1).alias("_first"))
    made = spans.withColumn("_end", F.coalesce("end", F.lit("9999-12-31").cast("date")))
    made = made.join(placed.select(F.col("_at").alias("start"), "_first"), "start").join(placed.select(F.col("_at").alias("_end"), "_last"), "_end")
    each = made.where("_first <= _last").withColumn("_n", F.explode(F.sequence("_first", "_last")))
    return each.join(F.broadcast(numbered), "_n").select(*spans.columns, "date")


def entries_of(feeds: DataFrame, column: str = "xml", most: int = 2000) -> DataFrame:
    """Entries of Atom feeds (source_url, xml): title, link, summary as plain text, time in UTC and kind of signal.

    The link is that of the page itself, else the first; the summary gives way to the content where there is none; the
    time is that of publication, else of the last change.
    """
    read = F.from_xml(column, f"struct<entry: array<{ENTRY}>>")
    items = feeds.select("source_url", F.explode(read["entry"]).alias("e"))
    own = F.filter("e.link", lambda x: x["_rel"].isNull() | (x["_rel"] == "alternate"))
    link = F.coalesce(F.get(own, F.lit(0))["_href"], F.get("e.link", F.lit(0))["_href"], F.lit(""))
    at = F.try_to_timestamp(F.coalesce("e.published", "e.updated"))
    return items.select(
        "source_url", F.coalesce("e.title", F.lit("")).alias("title"), link.alias("link"),
        F.substring(plain_text(F.coalesce("e.summary", "e.content", F.lit(""))), 1, most).alias("summary"), at.alias("published"),
        signal_kind(F.col("source_url"), F.col("e.title")).alias("signal_type"),
    )
