"""Queries of source shapes: nested JSON, parallel arrays, text numbers, names in display text."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paneltide.functions import text as X
from paneltide.plans.registry import query, shared_path, shown, shown_sql
from paneltide.sources import files
from paneltide.streaming import events as E


@query("s07_company_facts", shown_sql("""SELECT DISTINCT ticker, tag, start, "end", filed, val FROM facts WHERE "end" >= DATE '1997-01-01'""", ["ticker", "tag", "start", "end", "filed"], ["val"], 2), ["facts"])
def _(t):
    row = F.struct(*(F.col(c).cast("string").alias(c) for c in ("start", "end", "filed")), F.lit("10-Q").alias("form"), F.lit("Q1").alias("fp"), "val")
    tags = t.facts.groupBy("ticker", "tag").agg(F.struct(F.create_map(F.lit("USD"), F.collect_list(row)).alias("units")).alias("fact"))
    nested = tags.groupBy("ticker").agg(F.to_json(F.struct(F.create_map(F.lit("us-gaap"), F.map_from_entries(F.collect_list(F.struct("tag", "fact")))).alias("facts"))).alias("json"))
    raw = nested.select("ticker", F.from_json("json", files.FACT_SCHEMA).alias("j")).select("ticker", "j.facts")
    return shown(files.company_facts(raw, since="1997-01-01"), "ticker", "tag", "start", "end", "filed", "val", digits=2)


@query("s08_s09_s18_parallel_arrays", "SELECT DISTINCT ticker, form, filed FROM filings WHERE form = '10-Q' AND filed >= DATE '1996-01-01'", ["filings"])
def _(t):
    columns = t.filings.groupBy("ticker").agg(F.collect_list(F.struct("form", "filed")).alias("r")).select("ticker", F.col("r.form").alias("form"), F.col("r.filed").alias("filed"))
    return files.parallel_arrays(columns, "ticker", ["form", "filed"]).where("form = '10-Q' AND filed >= date'1996-01-01'").distinct()


@query("s09b_new_york_time", "SELECT event_id, timezone('America/New_York', timezone('UTC', ts)) AS at FROM events")
def _(t):
    return t.raw("events").select("event_id", F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), F.col("ts")).alias("at"))


@query("s11_s12_text_numbers", shown_sql("SELECT date, series, value FROM macro WHERE month(date) % 2 = 0", ["date", "series"], ["value"]), ["macro"])
def _(t):
    raw = t.macro.select("date", "series", F.when(F.month("date") % 2 == 0, F.col("value").cast("string")).otherwise(".").alias("text"))
    return shown(raw.select("date", "series", files.number_or_null("text").alias("value")).where("value IS NOT NULL"))


@query("s17_calendar_rows", "SELECT DISTINCT upper(ticker) AS symbol, filed AS earnings_date FROM filings WHERE form = '8-K'", ["filings"])
def _(t):
    return t.filings.where("form = '8-K'").select(F.upper("ticker").alias("symbol"), F.to_date("filed").alias("earnings_date")).distinct()


@query("s20_display_names", "SELECT id, name, lpad(cast(id AS varchar), 10, '0') AS cik FROM companies", ["companies"])
def _(t):
    shown_as = F.concat("name", F.lit(" (CIK "), X.padded_cik(F.col("id")), F.lit(")"))
    return t.companies.select("id", shown_as.alias("d")).select("id", F.regexp_replace("d", r"\s*\(CIK \d+\)\s*$", "").alias("name"), F.regexp_extract("d", r"\(CIK (\d+)\)", 1).alias("cik"))


@query("s25_s26_posts", shown_sql("SELECT page_id, substring(html, 1, 500) AS text, length(html) / 7.0 AS size FROM pages", ["page_id", "text"], ["size"], 4))
def _(t):
    return shown(t.raw("pages").select("page_id", F.substring("html", 1, 500).alias("text"), (F.length("html") / 7.0).cast("double").alias("size")), digits=4)


@query("s20b_filing_hits", """SELECT id, CASE WHEN id % 7 = 0 THEN '' ELSE name END AS entity_name, CASE WHEN id % 7 <> 0 AND id % 3 <> 0 THEN 'ABCD' END AS ticker, CASE WHEN id % 11 = 0 THEN '' ELSE cast(id AS varchar) END AS cik,
 CASE id % 3 WHEN 0 THEN '10-K' WHEN 1 THEN '8-K' ELSE '' END AS form_type, '2024-01-26' AS file_date, CASE WHEN id % 2 = 0 THEN 'n-' ELSE 'id-' END || id AS accession_number,
 CASE WHEN id % 5 <> 0 THEN '7372' END AS sic, CASE WHEN id % 4 <> 0 THEN country || ', X' END AS location FROM companies""", ["companies"])
def _(t):
    k = lambda n: F.col("id") % n
    some = lambda when, *x: F.when(when, F.array(*x)).otherwise(F.array().cast("array<string>"))
    display = F.concat("name", F.when(k(3) != 0, "  (ABCD)").otherwise(""), F.lit("  (CIK "), X.padded_cik(F.col("id")), F.lit(")"))
    source = F.struct(
        some(k(7) != 0, display).alias("display_names"), some(k(11) != 0, X.padded_cik(F.col("id"))).alias("ciks"), F.when(k(3) == 0, "10-K").alias("form"),
        some(k(3) == 1, F.lit("8-K")).alias("root_forms"), F.lit("2024-01-26").alias("file_date"), F.when(k(2) == 0, F.concat(F.lit("n-"), "id")).alias("adsh"),
        some(k(5) != 0, F.lit("7372")).alias("sics"), some(k(4) != 0, F.concat("country", F.lit(", X"))).alias("biz_locations"),
    )
    return files.filing_hits(t.companies.select("id", F.to_json(F.struct(F.concat(F.lit("id-"), "id").alias("_id"), source.alias("_source"))).alias("hit")))


@query("s25_posts", """SELECT cast(page_id AS varchar) AS id, substring(html, 1, 500) AS selftext, url FROM pages""")
def _(t):
    post = F.struct(F.col("page_id").cast("string").alias("id"), F.col("html").alias("selftext"), "url", F.lit(1.7e9).alias("created_utc"))
    pages = t.raw("pages").groupBy(F.pmod("page_id", F.lit(64)).alias("g")).agg(F.collect_list(F.struct(post.alias("data"))).alias("children"))
    listing = F.to_json(F.struct(F.struct("children").alias("data")))
    return files.posts(pages.select(listing.alias("listing"))).select("id", "selftext", "url")


@query("s26_price_history", shown_sql("SELECT ticker, cast(date AS varchar) AS date, open, high, low, close, cast(volume AS bigint) AS volume FROM panel", ["ticker", "date", "volume"], ["open", "high", "low", "close"], 4), ["panel"])
def _(t):
    return shown(files.price_history(t.panel.withColumn("date", F.date_format("date", "yyyy-MM-dd 00:00:00-05:00"))), digits=4)


@query("s26b_quotes", shown_sql("""SELECT cast(id AS varchar) AS symbol, CASE WHEN id % 2 = 0 THEN name WHEN id % 3 = 0 THEN sector ELSE cast(id AS varchar) END AS name,
 CASE WHEN id % 5 = 0 THEN id * 2.0::double ELSE id * 1.0::double END AS price FROM companies""", ["symbol", "name"], ["price"]), ["companies"])
def _(t):
    k = lambda n: F.col("id") % n
    info = t.companies.select(
        F.col("id").cast("string").alias("symbol"), F.when(k(2) == 0, F.col("name")).alias("longName"), F.when(k(3) == 0, F.col("sector")).otherwise("").alias("shortName"),
        F.when(k(5) == 0, 0.0).otherwise(F.col("id").cast("double")).alias("currentPrice"), (F.col("id") * 2.0).alias("regularMarketPrice"),
    )
    return shown(files.quote(info))


@query("s18_newest_filings", """SELECT ticker, filed FROM filings WHERE form = '10-Q' QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY filed DESC) <= 5""", ["filings"])
def _(t):
    return files.newest(t.filings.where("form = '10-Q'"), "ticker", "filed", 5).select("ticker", "filed")


@query("s29_folder_of_json", "SELECT id, 'signal_type=' || signal_type AS folder FROM signals WHERE signal_type IN ('ma', 'news', 'rss')", ["signals"])
def _(t):
    path = _shared(t, "folder")
    t.signals.select("id", "signal_type").write.partitionBy("signal_type").json(path)
    return files.json_folder(t.spark, f"{path}/signal_type=[mnr]*/*.json", "id long").select("id", "folder")


def _shared(t, name: str) -> str:
    return shared_path(t.spark, name)


@query("s28_s29_json_lines", "SELECT id, company_id, signal_type FROM signals", ["signals"])
def _(t):
    path = _shared(t, "jsonl")
    t.signals.select("id", "company_id", "signal_type").write.json(path)
    return files.json_lines(t.spark, path, "id long, company_id long, signal_type string")


@query("s05_w14_csv", shown_sql("SELECT id, name, score FROM companies", ["id", "name"], ["score"]), ["companies"])
def _(t):
    path = _shared(t, "csv")
    t.companies.select("id", "name", "score").write.option("header", True).csv(path)
    return shown(files.csv_table(t.spark, path, "id long, name string, score double"))


@query("s02_w02_partitioned_panel", shown_sql("SELECT date, ticker, close FROM panel WHERE ticker IN ('T00003', 'T00007') AND date >= DATE '1998-01-01'", ["date", "ticker"], ["close"]), ["panel"])
def _(t):
    path = _shared(t, "panel")
    files.write_partitioned(t.panel.select("date", "ticker", "close"), path, ["ticker"], ["date"])
    return shown(files.curated(t.spark, path, ["T00003", "T00007"], "1998-01-01"), "date", "ticker", "close")


@query("t07_first_seen_stream", "SELECT event_id, user_id FROM events")
def _(t):
    place = _shared(t, "first")
    rows = E.first_seen(E.read_stream(t.spark, t.folder), ["event_id"], "30 days").select("event_id", "user_id")
    E.run_once(rows, f"{place}/progress", f"{place}/rows")
    return t.spark.read.schema("event_id long, user_id long").parquet(f"{place}/rows")


@query("t09_late_rows_ignored", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def _(t):
    place = _shared(t, "merged")

    def merge(batch, epoch):
        # Each epoch has its own folder: a batch that is run again replaces what it wrote.
        first = batch.groupBy("user_id").agg(F.min("event_id").alias("event_id"))
        first.write.mode("overwrite").parquet(f"{place}/rows/epoch={epoch}")

    E.merge_batches(E.read_stream(t.spark, t.folder), f"{place}/progress", merge)
    return t.spark.read.schema("user_id long, event_id long").parquet(f"{place}/rows").groupBy("user_id").agg(F.min("event_id").alias("event_id")).select("user_id", "event_id")


@query("s05b_open_intervals", """SELECT ticker, start, "end" FROM membership""", ["membership"])
def _(t):
    path = _shared(t, "windows")
    t.membership.write.option("header", True).option("dateFormat", "MM/dd/yyyy").csv(path)
    raw = files.csv_table(t.spark, path, "ticker string, start string, end string")
    return raw.select("ticker", *(F.to_date(c, "MM/dd/yyyy").alias(c) for c in ("start", "end")))


@query("s06_fills_with_text_prices", "SELECT id, cast(round(value * 100) / 100 AS double) AS price FROM signals", ["signals"])
def _(t):
    path = _shared(t, "fills")
    t.signals.select("id", F.format_string("%.2f", F.round("value", 2)).alias("price")).write.option("header", True).csv(path)
    return files.csv_table(t.spark, path, "id long, price string").select("id", F.col("price").cast("decimal(18, 2)").cast("double").alias("price"))


@query("s09_continued_filings", "SELECT DISTINCT ticker, form, filed FROM filings WHERE filed >= DATE '1997-06-01'", ["filings"])
def _(t):
    def arrays(rows):
        held = F.collect_list(F.struct("form", "filed"))
        return rows.groupBy("ticker", F.year("filed").alias("year")).agg(held.alias("r")).select("ticker", F.col("r.form").alias("form"), F.col("r.filed").alias("filed"))

    recent, older = arrays(t.filings.where("filed >= date'1999-01-01'")), arrays(t.filings.where("filed < date'1999-03-01'"))
    rows = files.parallel_arrays(recent.unionByName(older), "ticker", ["form", "filed"])
    return rows.where("filed >= date'1997-06-01'").distinct().orderBy("ticker", "filed")


@query("s10_cik_map", "SELECT upper(name) AS ticker, lpad(cast(id AS varchar), 10, '0') AS cik FROM companies", ["companies"])
def _(t):
    entry = F.struct(F.col("id").alias("cik_str"), F.col("name").alias("ticker"))
    objects = t.companies.groupBy("country", F.pmod("id", F.lit(64))).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("id").cast("string"), entry)))).alias("json"))
    return files.map_rows(objects, "json", "cik_str: long, ticker: string").select(F.upper("ticker").alias("ticker"), X.padded_cik(F.col("cik_str")).alias("cik"))


OHLC = ["open", "high", "low", "close", "volume"]


@query("s14_adjusted_bars", shown_sql("SELECT date, ticker, open / 2 AS open, high / 2 AS high, low / 2 AS low, close / 2 AS close, volume * 2 AS volume FROM panel", ["date", "ticker"], OHLC), ["panel"])
def _(t):
    adjusted = {f"adj{c.capitalize()}": F.col(c) * 2 if c == "volume" else F.col(c) / 2 for c in OHLC}
    return shown(files.adjusted_bars(t.panel.withColumns(adjusted).withColumn("date", F.date_format("date", "yyyy-MM-dd'T'00:00:00.000'Z'"))))


@query("s15_text_bars", shown_sql("SELECT date, ticker, open, high, low, close, CASE WHEN day(date) = 3 THEN 0.0 ELSE volume END AS volume FROM panel WHERE day(date) <> 7", ["date", "ticker"], OHLC), ["panel"])
def _(t):
    volume = F.when(F.dayofmonth("date") == 3, "").otherwise(F.col("volume").cast("string"))
    line = F.when(F.dayofmonth("date") == 7, "Exceeded the daily hits limit").otherwise(F.concat_ws(",", "date", "open", "high", "low", "close", volume))
    return shown(files.bars_from_text(t.panel.select("ticker", line.alias("line"))))


@query("s16_inclusive_range", "SELECT date, ticker FROM panel WHERE date BETWEEN DATE '1996-02-01' AND DATE '1996-03-15'", ["panel"])
def _(t):
    return files.between_inclusive(t.panel.select("date", "ticker"), "1996-02-01", "1996-03-15")


#: Which series tells the employment of a sector.
EMPLOYMENT = {"BUILDING": "VIX", "MACHINERY": "DGS10", "FURNITURE": "T10Y2Y"}


@query("s23_sector_series", shown_sql("""SELECT sector, series, date, value FROM (SELECT s.sector, m.*, row_number() OVER (PARTITION BY s.sector ORDER BY date DESC) AS n FROM macro m
 JOIN (VALUES ('BUILDING', 'VIX'), ('MACHINERY', 'DGS10'), ('FURNITURE', 'T10Y2Y')) s(sector, series) USING (series)) WHERE n <= 12""", ["sector", "series", "date"], ["value"]), ["macro"])
def _(t):
    names = t.spark.createDataFrame([*EMPLOYMENT.items()], "sector string, series string")
    w = Window.partitionBy("sector").orderBy(F.col("date").desc())
    rows = t.macro.join(F.broadcast(names), "series").withColumn("n", F.row_number().over(w)).where("n <= 12")
    return shown(rows, "sector", "series", "date", "value")


@query("s24_feed_items", """SELECT 'https://feeds/' || CASE WHEN user_id % 3 = 0 THEN 'merger' ELSE 'news' END AS source_url, event_type || ' & ' || event_id AS title, 'https://x/' || event_id AS link,
 'a  b' || value AS summary, date_trunc('second', ts) AS published, CASE WHEN user_id % 3 = 0 THEN 'ma' ELSE 'news' END AS signal_type FROM events""")
def _(t):
    part = lambda tag, x: F.concat(F.lit(f"<{tag}>"), x, F.lit(f"</{tag}>"))
    said = F.concat(F.lit("&lt;p&gt;a &lt;b&gt;b"), F.col("value").cast("string"), F.lit("&lt;/p&gt;"))
    at = F.concat(F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    fields = [part("title", F.concat("event_type", F.lit(" &amp; "), "event_id")), part("link", F.concat(F.lit("https://x/"), "event_id")), part("description", said), part("pubDate", at)]
    url = F.concat(F.lit("https://feeds/"), F.when(F.col("user_id") % 3 == 0, "merger").otherwise("news"))
    items = t.raw("events").select(url.alias("source_url"), F.pmod("event_id", F.lit(100)).alias("g"), part("item", F.concat(*fields)).alias("item"))
    feeds = items.groupBy("source_url", "g").agg(part("rss", part("channel", F.array_join(F.collect_list("item"), ""))).alias("xml"))
    return files.feed_items(feeds).withColumn("published", F.col("published").cast("timestamp_ntz"))


@query("w03_snapshot_once", shown_sql("SELECT date, series, value FROM macro WHERE date < DATE '1998-01-01'", ["date", "series"], ["value"]), ["macro"])
def _(t):
    path = _shared(t, "macro-1998-01-01")
    files.write_once(t.macro.where("date < date'1998-01-01'"), path)
    files.write_once(t.macro, path)
    return shown(t.spark.read.schema(t.macro.schema).parquet(path))


@query("w15_json_artifacts", shown_sql("SELECT ticker, count(*) AS n, max(close) AS top FROM panel GROUP BY ticker", ["ticker", "n"], ["top"]), ["panel"])
def _(t):
    path = _shared(t, "summary")
    made = t.panel.groupBy("ticker").agg(F.struct(F.count("*").alias("n"), F.max("close").alias("top")).alias("summary"))
    made.write.json(path)
    return shown(files.json_lines(t.spark, path, "ticker string, summary struct<n: long, top: double>").select("ticker", "summary.n", "summary.top"))


@query("k08_newest_decision", """SELECT user_id, arg_max(event_id, (cast(ts AS date), CASE WHEN event_type = 'error' THEN strftime(ts, '_r%H%M') ELSE '' END, event_id)) AS event_id FROM events GROUP BY user_id""")
def _(t):
    # A revision's file name goes on behind the daily one's, so it is the later of the two.
    rank = F.struct(F.to_date("ts"), F.when(F.col("event_type") == "error", F.date_format("ts", "'_r'HHmm")).otherwise(""), "event_id")
    return t.raw("events").groupBy("user_id").agg(F.max_by("event_id", rank).alias("event_id"))
