"""Typed readers of CSV, JSON lines and nested JSON, and partitioned writers."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paneltide.functions.text import plain_text, signal_kind


def curated(spark: SparkSession, path: str, tickers: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Panel rows of a Parquet folder with one folder a ticker; every filter reaches the scan, and only the folders of the named tickers are listed."""
    plain = [x for x in tickers or [] if re.fullmatch(r"[A-Za-z][A-Za-z0-9_-]*", x)]
    try:
        if not plain or len(plain) < len(tickers):
            raise AnalysisException("some names are written in another way in a path")
        df = spark.read.option("basePath", path).parquet(f"{path}/ticker={{{','.join(plain)}}}")
    except AnalysisException:  # or none of them has a folder
        df = spark.read.parquet(path)
    if tickers:
        df = df.where(F.col("ticker").isin(*tickers))
    if start:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    return df.where(F.col("date") <= F.lit(end).cast("date")) if end else df


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header whose names must be those of the schema."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def number_or_null(x: str):
    return F.expr(f"try_cast(`{x}` AS double)")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


FACT_SCHEMA = "facts map<string, map<string, struct<units: map<string, array<struct<start: string, end: string, filed: string, form: string, fp: string, val: double>>>>>>"


def company_facts(raw: DataFrame, since: str = "2016-01-01") -> DataFrame:
    """Nested company facts (ticker, facts) -> one row per reported value."""
    tags = raw.select("ticker", F.explode(F.col("facts")["us-gaap"]).alias("tag", "fact"))
    units = tags.select("ticker", "tag", F.explode("fact.units").alias("unit", "rows")).select("ticker", "tag", "unit", F.explode("rows").alias("r"))
    made = units.select("ticker", "tag", "unit", *(F.expr(f"try_cast(r.{c} AS date)").alias(c) for c in ("start", "end", "filed")), "r.form", "r.fp", "r.val")
    return made.where(F.col("end").isNotNull() & F.col("filed").isNotNull() & F.col("val").isNotNull() & (F.col("end") >= since)).dropDuplicates(["ticker", "tag", "unit", "start", "end", "filed"])


def parallel_arrays(raw: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of a table that is written as one array per column."""
    return raw.select(key, F.explode(F.arrays_zip(*columns)).alias("_r")).select(key, *(F.col(f"_r.{c}") for c in columns))


def write_partitioned(df: DataFrame, path: str, by: list[str], order: list[str]) -> None:
    """Replaces a dataset: few sorted files per partition value."""
    df.repartition(*by).sortWithinPartitions(*by, *order).write.mode("overwrite").partitionBy(*by).parquet(path)


def map_rows(objects: DataFrame, column: str, value: str, key: str = "key") -> DataFrame:
    """Rows of JSON objects of objects: each entry's key and the fields of its value (a DDL schema)."""
    parsed = objects.select(F.from_json(column, f"map<string, struct<{value}>>").alias("m"))
    return parsed.select(F.explode("m").alias(key, "_v")).select(key, "_v.*")


BAR = ("open", "high", "low", "close", "volume")


def adjusted_bars(raw: DataFrame) -> DataFrame:
    """Bars from rows that hold raw and adjusted columns: the adjusted ones are taken before any gets its name."""
    return raw.select(F.to_date("date").alias("date"), "ticker", *(F.col(f"adj{c.capitalize()}").cast("double").alias(c) for c in BAR))


def bars_from_text(lines: DataFrame, column: str = "line") -> DataFrame:
    """Bars from CSV lines (ticker, line) of a vendor that answers errors as text; a missing volume is 0."""
    fields = F.from_csv(F.col(column), "date date, open double, high double, low double, close double, volume double")
    parsed = lines.where(~F.lower(column).rlike("no data|exceeded|apikey")).select("ticker", fields.alias("b"))
    rows = parsed.where("b.date IS NOT NULL AND b.close IS NOT NULL")
    return rows.select("b.date", "ticker", *(F.col(f"b.{c}") for c in BAR[:4]), F.coalesce("b.volume", F.lit(0.0)).alias("volume"))


def between_inclusive(rows: DataFrame, start: str, end: str, at: str = "date") -> DataFrame:
    """Rows of a half-open source range whose end is meant to be in it."""
    return rows.where((F.col(at) >= F.lit(start).cast("date")) & (F.col(at) < F.date_add(F.lit(end).cast("date"), 1)))


ITEM = "title string, link string, description string, pubDate string"


def feed_items(feeds: DataFrame, column: str = "xml") -> DataFrame:
    """Items of feeds (source_url, xml): title, link, summary as plain text, time in UTC and kind of signal."""
    items = feeds.select("source_url", F.explode(F.from_xml(column, f"channel struct<item: array<struct<{ITEM.replace(' string', ': string')}>>>")["channel"]["item"]).alias("i"))
    without_day = F.regexp_replace("i.pubDate", r"^[A-Za-z]{3},\s*", "")
    at = F.coalesce(F.try_to_timestamp(without_day, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp("i.pubDate"))
    return items.select("source_url", "i.title", "i.link", plain_text(F.col("i.description")).alias("summary"), at.alias("published"), signal_kind(F.col("source_url"), F.col("i.title")).alias("signal_type"))


def write_once(df: DataFrame, path: str) -> None:
    """A dated snapshot: what is there already stays as it is."""
    df.write.mode("ignore").parquet(path)


HIT = """_id string, _source struct<display_names: array<string>, ciks: array<string>, form: string, root_forms: array<string>,
 file_date: string, adsh: string, sics: array<string>, biz_locations: array<string>>"""


def filing_hits(raw: DataFrame, column: str = "hit") -> DataFrame:
    """Hits of a filing search (JSON) as rows: name, ticker and CIK from the display name, form, date, number, SIC, place.

    The name loses its CIK and then its ticker in brackets; a hit without a display name has an empty name.
    """
    hit = raw.withColumn("_h", F.from_json(column, HIT))
    source = lambda name: F.col(f"_h._source.{name}")
    first = lambda name: F.get(source(name), F.lit(0))
    named = F.trim(F.regexp_replace(F.coalesce(first("display_names"), F.lit("")), r"\s*\(CIK\s+\d+\)\s*$", ""))
    ticker = F.nullif(F.regexp_extract(named, r"\(([A-Z]{1,5})\)\s*$", 1), F.lit(""))
    return hit.select(
        *(c for c in raw.columns if c != column),
        F.when(ticker.isNull(), named).otherwise(F.trim(F.regexp_replace(named, r"\([A-Z]{1,5}\)\s*$", ""))).alias("entity_name"),
        ticker.alias("ticker"),
        F.ltrim(F.coalesce(first("ciks"), F.lit("")), F.lit("0")).alias("cik"),
        F.coalesce(source("form"), first("root_forms"), F.lit("")).alias("form_type"),
        F.coalesce(source("file_date"), F.lit("")).alias("file_date"),
        F.coalesce(source("adsh"), F.col("_h._id"), F.lit("")).alias("accession_number"),
        first("sics").alias("sic"), first("biz_locations").alias("location"),
    )


POST = "id string, title string, selftext string, score long, url string, created_utc double"


def posts(raw: DataFrame, column: str = "listing", most: int = 500) -> DataFrame:
    """Posts of search listings (JSON: data.children[].data), their text cut."""
    listing = F.from_json(column, f"data struct<children: array<struct<data: struct<{POST.replace(' ', ': ').replace(',:', ',')}>>>>")
    rows = raw.select(F.explode(listing["data"]["children"]["data"]).alias("p")).select("p.*")
    return rows.withColumn("selftext", F.substring("selftext", 1, most)).withColumn("created_utc", F.timestamp_seconds("created_utc"))


def price_history(bars: DataFrame) -> DataFrame:
    """Bars as a quote service lists them: the day of the time stamp, prices to four places, whole volumes."""
    prices = (F.round(F.col(c).cast("double"), 4).alias(c) for c in BAR[:4])
    return bars.select("ticker", F.substring(F.col("date").cast("string"), 1, 10).alias("date"), *prices, F.col("volume").cast("long").alias("volume"))


def quote(info: DataFrame) -> DataFrame:
    """A quote from a vendor's fields: the long name, else the short one, else the symbol; the current price, else the market's.

    Empty names and prices of 0 count as missing.
    """
    name = F.coalesce(F.nullif("longName", F.lit("")), F.nullif("shortName", F.lit("")), "symbol")
    price = F.coalesce(F.nullif("currentPrice", F.lit(0.0)), "regularMarketPrice")
    return info.select("symbol", name.alias("name"), price.alias("price"))


def newest(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The `most` newest rows of each key."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def json_folder(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """All JSON files that match a pattern, with the name of the folder that each row came from."""
    rows = spark.read.schema(schema).json(pattern)
    return rows.withColumn("folder", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
