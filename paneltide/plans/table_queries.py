"""Queries of keyed tables, filters, text functions and event streams, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneltide.functions import text as X
from paneltide.operators import tables as K
from paneltide.operators import windows as W
from paneltide.plans.registry import query, shared_path, shown, shown_sql
from paneltide.plans.relational_queries import TOP, top_weights
from paneltide.plans.window_queries import MKT, RET
from paneltide.streaming import events as E
from paneltide.streaming import keyed as KS
from paneltide.streaming import stored as ST

# ------------------------------------------------------------- tables


@query("w01_append_missing", "SELECT id, company_id FROM stages WHERE id % 2 = 0 UNION ALL SELECT id, company_id FROM (SELECT DISTINCT id, company_id FROM stages) WHERE id NOT IN (SELECT id FROM stages WHERE id % 2 = 0)", ["stages"])
def _(t):
    s = t.stages.select("id", "company_id")
    return K.append_missing(s.where("id % 2 = 0"), s, ["id"])


@query("w04_insert_ignore", "SELECT company_id, min(id) AS id FROM stages WHERE company_id % 2 = 1 GROUP BY company_id UNION ALL SELECT company_id, max(id) FROM stages WHERE company_id % 2 = 0 GROUP BY company_id", ["stages"])
def _(t):
    old = t.stages.where("company_id % 2 = 0").groupBy("company_id").agg(F.max("id").alias("id"))
    return K.insert_ignore(old, t.stages.select("company_id", "id"), ["company_id"], "id")


@query("w05_filled_status", "SELECT id, CASE WHEN id IN (SELECT company_id FROM signals) THEN 'filled' ELSE stage END AS status FROM stages", ["stages", "signals"])
def _(t):
    return K.filled_status(t.stages.select("id", F.col("stage").alias("status")), t.signals.select(F.col("company_id").alias("id")))


@query("w06_equity_mark", shown_sql("SELECT ticker, date, max(close) OVER (PARTITION BY ticker ORDER BY date) AS high_water_mark FROM panel", ["ticker", "date"], ["high_water_mark"]), ["panel"])
def _(t):
    w = W.by_ticker().rowsBetween(W.Window.unboundedPreceding, 0)
    return shown(t.panel.select("ticker", "date", F.max("close").over(w).alias("high_water_mark")))


@query("w07_slippage", shown_sql("SELECT strftime(date, '%Y-%m') AS month, avg(abs(close - open) / open * 1e4) AS realized_bps, count(*) AS n_fills FROM panel WHERE open > 0 GROUP BY 1", ["month", "n_fills"], ["realized_bps"], 4), ["panel"])
def _(t):
    fills = t.panel.select("ticker", "date", F.col("date").alias("fill_date"), F.col("close").alias("price"))
    return shown(K.slippage(fills, t.panel.select("ticker", "date", F.col("open").alias("limit_price")), ["ticker", "date"]), digits=4)


@query("w08_upsert", "SELECT id, CASE WHEN score IS NULL THEN 0.0 ELSE score END AS score FROM companies", ["companies"])
def _(t):
    c = t.companies.select("id", "score")
    return K.upsert(c, c.where("score IS NULL").select("id", F.lit(0.0).alias("score")), ["id"])


@query("w09_outcomes", shown_sql("SELECT ticker, date, CASE WHEN day(date) < 15 THEN 0.0 ELSE lead(close, 5) OVER (PARTITION BY ticker ORDER BY date) / nullif(close, 0) - 1 END AS fwd_return FROM panel", ["ticker", "date"], ["fwd_return"]), ["panel"])
def _(t):
    log = t.panel.select("ticker", "date", F.when(F.dayofmonth("date") < 15, 0.0).alias("fwd_return"))
    return shown(K.outcomes(log, W.labels(t.panel).select("ticker", "date", F.col("fwd_ret").alias("fwd_return")), "fwd_return"))


@query("w10_patch", "SELECT id, name, CASE WHEN id % 10 = 0 THEN 'patched' ELSE sector END AS sector FROM companies", ["companies"])
def _(t):
    patch = t.companies.where("id % 5 = 0").select("id", F.when(F.col("id") % 10 == 0, "patched").alias("sector"))
    return K.patched(t.companies.select("id", "name", "sector"), patch, "id")


@query("w10b_cascade", "SELECT id, company_id FROM stages WHERE company_id NOT IN (SELECT id FROM companies WHERE score < 20)", ["stages", "companies"])
def _(t):
    return K.without(t.companies, t.stages.select("id", "company_id"), t.companies.where("score < 20"), "id", "company_id")[1]


@query("w11_new_companies", r"""WITH n AS (SELECT *, lower(trim(regexp_replace(regexp_replace(name || CASE WHEN id % 2 = 0 THEN ' (ABC, X-1)' ELSE '' END, '\s*\([A-Z0-9,\-\s]{1,30}\)\s*$', ''), '\s+', ' ', 'g'))) AS key FROM companies)
 SELECT id, key FROM n WHERE id % 3 <> 0 AND key NOT IN (SELECT lower(name) FROM companies WHERE id % 3 = 0)""", ["companies"])
def _(t):
    incoming = t.companies.where("id % 3 <> 0").select("id", F.concat("name", F.when(F.col("id") % 2 == 0, " (ABC, X-1)").otherwise("")).alias("name"))
    return K.new_companies(t.companies.where("id % 3 = 0"), incoming, "id").select("id", K.normal_name(F.col("name")).alias("key"))


@query("w13_table_hash")
def _(t):
    return K.table_hash(t.panel, ["date", "ticker", "close"])


@query("w16_ticket", "SELECT date, '| rank | ticker | weight | side |' || chr(10) || string_agg(printf('| %d | %s | %.2f | %s |', n, ticker, 0.2::double, 'BUY'), chr(10) ORDER BY n) AS markdown FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ticker) AS n FROM ({0})) GROUP BY date".format(TOP), ["panel"])
def _(t):
    w = W.Window.partitionBy("date").orderBy("ticker")
    return K.ticket(top_weights(t).select("date", "ticker", F.row_number().over(w).alias("rank"), F.col("w").alias("weight"), F.lit("BUY").alias("side")))


@query("x09_limit_prices", "SELECT date, ticker, cast(CASE WHEN volume > 25 THEN round(cast(round(close, 6) AS decimal(18,6)) * 1.002::decimal(6,3), 2) ELSE round(cast(round(close, 6) AS decimal(18,6)) * 0.998::decimal(6,3), 2) END AS double) AS price FROM panel", ["panel"])
def _(t):
    side = F.when(F.col("volume") > 25, "BUY").otherwise("SELL")
    return t.panel.select("date", "ticker", K.limit_price(F.round("close", 6), side).cast("double").alias("price"))


# ------------------------------------------------------------ filters


@query("p01_labelled_range", "SELECT date, ticker FROM (SELECT date, ticker, lead(close, 5) OVER (PARTITION BY ticker ORDER BY date) AS f FROM panel) WHERE f IS NOT NULL AND date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'", ["panel"])
def _(t):
    return W.labels(t.panel).where("fwd_ret IS NOT NULL AND date BETWEEN date'1996-01-01' AND date'1999-12-31'").select("date", "ticker")


SPLIT = " OR ".join(f"abs(g * {k} - 1) < 0.005 OR abs(g / {k} - 1) < 0.005" for k in ("2.0", "3.0", "4.0", "5.0", "6.0", "8.0", "10.0", "1.5::double", "(4.0::double / 3)", "1.25::double"))


@query("p04_splits", f"SELECT date, ticker FROM (SELECT date, ticker, ret + 1 AS g FROM ({RET})) WHERE g > 0 AND ({SPLIT})", ["panel"])
def _(t):
    return W.with_returns(t.panel).where(X.looks_like_split(F.col("ret") + 1)).select("date", "ticker")


#: A bar as two vendors deliver it, the later one corrected on every eleventh day of the year.
FEED = """SELECT date, ticker, open, high, low, CASE WHEN dayofyear(date) % 29 = 0 THEN close * 2 WHEN dayofyear(date) % 31 = 0 THEN close * 1.53::double ELSE close END AS close, 1 AS seq FROM panel
 UNION ALL SELECT date, ticker, open, high, low, close, 2 FROM panel WHERE dayofyear(date) % 29 = 0 AND ticker > 'T00030'"""


def feed(t):
    day = F.dayofyear("date")
    wrong = F.when(day % 29 == 0, F.col("close") * 2).when(day % 31 == 0, F.col("close") * 1.53).otherwise(F.col("close"))
    bars = t.panel.select("date", "ticker", "open", "high", "low", "close")
    again = bars.where((day % 29 == 0) & (F.col("ticker") > "T00030")).withColumn("seq", F.lit(2))
    return bars.withColumns({"close": wrong, "seq": F.lit(1)}).unionByName(again)


KEPT = f"SELECT date, ticker, open, high, low, arg_max(close, seq) AS close FROM ({FEED}) GROUP BY ALL"
CHECKS = f"""SELECT ticker, n, bad, crossed, jumps, splits, n >= 260 AND bad = 0 AND crossed = 0 AND splits = 0 AND jumps < 8 AS ok FROM (
 SELECT ticker, count(*) AS n, count(*) FILTER (least(open, high, low, close) <= 0) AS bad, count(*) FILTER (high < low) AS crossed,
 count(*) FILTER (abs(g - 1) > 0.40 AND near) AS jumps, count(*) FILTER (abs(g - 1) > 0.40 AND near AND ({SPLIT})) AS splits FROM (
 SELECT *, close / lag(close) OVER w AS g, date_diff('day', lag(date) OVER w, date) <= 7 AS near FROM ({KEPT}) WINDOW w AS (PARTITION BY ticker ORDER BY date)) GROUP BY ticker)"""


@query("k06_keep_last", shown_sql(KEPT, ["date", "ticker"], ["close"]), ["panel"])
def _(t):
    return shown(K.keep_last(feed(t), ["date", "ticker"], "seq"), "date", "ticker", "close")


@query("p05_valid_series", CHECKS, ["panel"])
def _(t):
    return K.series_checks(K.keep_last(feed(t), ["date", "ticker"], "seq"))


@query("p06_surviving_series", f"SELECT ticker FROM (SELECT ticker, count(*) AS n FROM panel GROUP BY ticker) WHERE n >= 260", ["panel"])
def _(t):
    return K.surviving(K.series_checks(t.panel, move=1e9), least_share=0.0)


@query("p10_unscored", "SELECT id, name FROM companies WHERE score IS NULL", ["companies"])
def _(t):
    return t.companies.where("score IS NULL").select("id", "name")


@query("p11_p12_p13_actions", """SELECT id, CASE WHEN score >= 80 THEN 'pursue' WHEN score >= 60 THEN 'watch' WHEN score IS NOT NULL THEN 'pass' END AS action, coalesce(score >= 60, false) AS monitored,
 CASE WHEN score >= 70 THEN 'On Track' WHEN score < 45 THEN 'Alert' ELSE 'Watch' END AS status, CASE WHEN score >= 75 THEN 'green' WHEN score >= 50 THEN 'yellow' WHEN score < 50 THEN 'red' END AS badge FROM companies""", ["companies"])
def _(t):
    score = F.col("score")
    return t.companies.select("id", X.action(score).alias("action"), F.coalesce(score >= 60, F.lit(False)).alias("monitored"), X.status(score).alias("status"), X.badge(score).alias("badge"))


def search(companies, text: str, **filters: str):
    """Companies whose name or country holds the text, and whose columns have the given values; "all" is any."""
    low = text.lower()
    made = companies.where(F.lower("name").contains(low) | F.lower("country").contains(low))
    for column, value in filters.items():
        made = made if value == "all" else made.where(F.col(column) == value)
    return made


@query("p14_search", "SELECT id, 'one' AS which FROM companies WHERE (contains(lower(name), 'r#0000000') OR contains(lower(country), 'r#0000000')) AND sector = 'BUILDING' UNION ALL SELECT id, 'all' FROM companies WHERE contains(lower(country), '1') OR contains(lower(name), '1')", ["companies"])
def _(t):
    one = search(t.companies, "R#0000000", sector="BUILDING", country="all")
    return one.select("id", F.lit("one").alias("which")).unionByName(search(t.companies, "1", sector="all").select("id", F.lit("all").alias("which")))


#: Of a company's ten newest figures the three oldest are looked at.
KPI_ALERTS = """SELECT company_id::varchar AS key, cast(recorded_at::date AS varchar) AS at, 'growth' AS severity FROM (
 SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY recorded_at, id) AS m FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY recorded_at DESC, id DESC) AS n FROM kpis) WHERE n <= 10)
 WHERE m <= 3 AND metric_name = 'revenue_growth' AND value < -0.1"""


@query("p15_alerts", f"""SELECT ticker AS key, cast(date AS varchar) AS at, CASE WHEN abs(ret) >= 0.10 THEN 'high' ELSE 'medium' END AS severity FROM ({RET}) WHERE abs(ret) >= 0.05
 UNION ALL SELECT company_id::varchar, cast(created_at::date AS varchar), 'filing' FROM signals WHERE signal_type = 'sec_8k' UNION ALL {KPI_ALERTS}""", ["panel", "signals", "kpis"])
def _(t):
    text = lambda c: F.col(c).cast("string")
    size = F.when(F.abs("ret") >= 0.10, "high").otherwise("medium").alias("severity")
    moves = W.with_returns(t.panel).where(F.abs("ret") >= 0.05).select(F.col("ticker").alias("key"), text("date").alias("at"), size)
    filed = t.signals.where("signal_type = 'sec_8k'").select(text("company_id").alias("key"), F.to_date("created_at").cast("string").alias("at"), F.lit("filing").alias("severity"))
    w = W.Window.partitionBy("company_id").orderBy("recorded_at", "id")
    oldest = W.last_values(t.kpis, "company_id", ["recorded_at", "id"], 10).withColumn("m", F.row_number().over(w)).where("m <= 3")
    low = oldest.where("metric_name = 'revenue_growth' AND value < -0.1")
    return moves.unionByName(filed).unionByName(low.select(text("company_id").alias("key"), F.to_date("recorded_at").cast("string").alias("at"), F.lit("growth").alias("severity")))


# --------------------------------------------------------------- text


@query("x01_page_text", "SELECT page_id, length(trim(regexp_replace(html, '<[^>]+>', ' ', 'g'), ' ')[1:2000]) AS n, lower(regexp_extract(url, '^[a-z]+://([^/:]+)', 1)) AS host FROM pages")
def _(t):
    return t.raw("pages").select("page_id", F.length(X.plain_text(F.col("html"))).cast("long").alias("n"), X.host(F.col("url")).alias("host"))


@query("x02_event_props", "SELECT event_id, cast(json_extract(props, '$.k') AS bigint) AS k FROM events")
def _(t):
    return t.raw("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("x03_names_and_kinds", "SELECT id, upper(replace(name, '.', '-')) AS symbol, lpad(ltrim(cast(id AS varchar), '0'), 10, '0') AS cik, CASE WHEN contains(lower(name), '8-k') THEN 'sec_8k' WHEN regexp_matches(lower(name), 'acqui|merger|deal|takeover|buyout') THEN 'ma' ELSE 'news' END AS kind FROM companies", ["companies"])
def _(t):
    return t.companies.select("id", X.ticker_symbol(F.col("name")).alias("symbol"), X.padded_cik(F.col("id")).alias("cik"), X.signal_kind(F.lit("rss"), F.col("name")).alias("kind"))


@query("x04_reply_scores", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN greatest(0.0, least(100.0, trunc(value))) WHEN 1 THEN least(100.0, (event_id % 150)::double) WHEN 2 THEN 85.0 ELSE 50.0 END::double AS score FROM events""")
def _(t):
    e, k = t.raw("events"), F.col("event_id") % 5
    number = (F.col("event_id") % 150).cast("string")
    reply = (
        F.when(k == 0, F.concat(F.lit('well: {"score": '), F.col("value").cast("string"), F.lit("} so"))).when(k == 1, F.concat(F.lit("I say "), number, F.lit(" here")))
        .when(k == 2, "in 2024 I say 85, or 90").when(k == 3, '{"risk": 7}').otherwise("none of 1000")
    )
    return e.select("event_id", X.score_reply(reply).alias("score"))


@query("x06_session_calendar", "SELECT date, n, lead(date, 3) OVER (ORDER BY date) AS third_next FROM (SELECT date, row_number() OVER (ORDER BY date) AS n FROM (SELECT DISTINCT date FROM panel))", ["panel"])
def _(t):
    w = W.Window.orderBy("date")
    return t.panel.select("date").distinct().select("date", F.row_number().over(w).cast("long").alias("n"), F.lead("date", 3).over(w).alias("third_next"))


@query("x07_decision_weights", "SELECT event_id, CASE event_type WHEN 'purchase' THEN CASE WHEN value > 66 THEN 1.0 WHEN value > 33 THEN 0.66 ELSE 0.33 END WHEN 'error' THEN 0.0 ELSE 0.5 END::double AS weight FROM events")
def _(t):
    v = F.col("value")
    act = F.when(F.col("event_type") == "purchase", "BUY").when(F.col("event_type") == "error", "SELL").otherwise("HOLD")
    return t.raw("events").select("event_id", X.decision_weight(act, F.when(v > 66, "HIGH").when(v > 33, "MEDIUM").otherwise("LOW"), F.lit(0.5)).alias("weight"))


# ------------------------------------------------------------- streams


def stamped(t):
    return t.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))


def plain(df):
    return df.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("t01_tumbling", shown_sql("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL", ["start", "end", "event_type", "n"], ["total"], 3))
def _(t):
    return shown(plain(E.windowed(stamped(t), "1 hour")), digits=3)


@query("t02_sliding", shown_sql("SELECT s AS start, s + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, sum(value) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) GROUP BY ALL", ["start", "end", "event_type", "n"], ["total"], 3))
def _(t):
    return shown(plain(E.windowed(stamped(t), "1 hour", "30 minutes")), digits=3)


@query("t03_sessions", "SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", user_id, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, g")
def _(t):
    return plain(E.sessions(stamped(t), "30 minutes"))


@query("t04_new_sessions_only", "SELECT date FROM (SELECT date, max(date) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT DISTINCT cast(ts AS date) AS date FROM events)) WHERE before IS NULL OR date > before")
def _(t):
    days = t.raw("events").select(F.to_date("ts").alias("date")).distinct()
    before = F.max("date").over(W.Window.orderBy("date").rowsBetween(W.Window.unboundedPreceding, -1))
    return days.withColumn("before", before).where("before IS NULL OR date > before").select("date")


@query("t05_cooldown_stream")
def _(t):
    place = shared_path(t.spark, "stream")
    E.run_once(E.with_cooldown(E.read_stream(t.spark, t.folder), 90.0, 90), f"{place}/progress", f"{place}/rows")
    return t.spark.read.schema(E.FIRED).parquet(f"{place}/rows")


@query("t06_changes_only", "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events) WHERE event_type IS DISTINCT FROM before")
def _(t):
    return E.changes_only(t.raw("events"), "user_id", "ts", "event_type").select("event_id", "user_id", "event_type")


ACTIONS = "SELECT event_id, user_id, ts, CASE event_type WHEN 'purchase' THEN 'BUY' WHEN 'error' THEN 'SELL' ELSE 'HOLD' END AS action FROM events"


@query("t06b_decision_alerts", f"""SELECT event_id, user_id, action FROM (SELECT *, lag(action) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM ({ACTIONS}))
 WHERE action IN ('BUY', 'SELL') AND action IS DISTINCT FROM before""")
def _(t):
    act = F.when(F.col("event_type") == "purchase", "BUY").when(F.col("event_type") == "error", "SELL").otherwise("HOLD")
    decisions = t.raw("events").select("event_id", "user_id", "ts", act.alias("action"))
    return E.decision_alerts(decisions, "user_id", ["ts", "event_id"], "action").select("event_id", "user_id", "action")


@query("t08_only_newer", "SELECT event_id FROM events WHERE cast(ts AS date) > (SELECT max(cast(ts AS date)) FROM events WHERE event_id < 5000)")
def _(t):
    e = t.raw("events").withColumn("day", F.to_date("ts"))
    newest = e.where("event_id < 5000").agg(F.max("day")).first()[0]
    return e.where(F.col("day") > F.lit(newest)).select("event_id")


@query("t10_stale_tickers", "SELECT ticker, max(date) AS last FROM panel GROUP BY ticker HAVING max(date) < DATE '2001-10-25'", ["panel"])
def _(t):
    return t.panel.groupBy("ticker").agg(F.max("date").alias("last")).where("last < date'2001-10-25'")


@query("e01_rest_company_detail", "SELECT c.id, c.name, count(s.id) AS n_signals FROM companies c LEFT JOIN signals s ON s.company_id = c.id GROUP BY ALL", ["companies", "signals"])
def _(t):
    n = t.signals.groupBy("company_id").agg(F.count("*").alias("n_signals"))
    return t.companies.select("id", "name").join(n, F.col("id") == F.col("company_id"), "left").select("id", "name", F.coalesce("n_signals", F.lit(0)).alias("n_signals"))


@query("e02_weekly_report", "SELECT sector, count(*) AS companies, cast(count(*) FILTER (score >= 80) AS bigint) AS pursue, cast(count(*) FILTER (score IS NULL) AS bigint) AS unscored FROM companies GROUP BY sector", ["companies"])
def _(t):
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return t.companies.groupBy("sector").agg(F.count("*").alias("companies"), n(F.col("score") >= 80).alias("pursue"), n(F.col("score").isNull()).alias("unscored"))


#: Greedy in order of time: after a row that fired, the next one at least 90 minutes later. Rows from an hour before the newest on still wait.
COOLED = """WITH RECURSIVE high AS (SELECT user_id, ts, min(value) AS value FROM events WHERE value >= 90 GROUP BY ALL),
 fired AS (SELECT user_id, min(ts) AS ts FROM high GROUP BY user_id
 UNION ALL SELECT * FROM (SELECT f.user_id, (SELECT min(h.ts) FROM high h WHERE h.user_id = f.user_id AND h.ts >= f.ts + INTERVAL 90 MINUTE) AS ts FROM fired f) WHERE ts IS NOT NULL)
 SELECT user_id, ts, round(value, 6) + 0.0 AS value FROM fired JOIN high USING (user_id, ts)
 WHERE epoch_ms(ts) < (SELECT epoch_ms(max(ts)) - 3600000 FROM events)"""


@query("t05b_cooldown_in_event_time", COOLED)
def _(t):
    place = shared_path(t.spark, "cooldown")
    E.run_once(KS.with_cooldown(E.read_stream(t.spark, t.folder), 90.0, 90, "1 hour"), f"{place}/progress", f"{place}/rows")
    fired = t.spark.read.schema(KS.FIRED).parquet(f"{place}/rows")
    return shown(fired.withColumn("ts", F.col("ts").cast("timestamp_ntz")))


@query("t07b_session_revisions", """SELECT user_id, session, row_number() OVER (PARTITION BY user_id, session ORDER BY event_id) - 1 AS revision, event_id, payload FROM (
 SELECT user_id, cast(ts AS date) AS session, event_id, event_type AS payload, lag(event_type) OVER (PARTITION BY user_id, cast(ts AS date) ORDER BY event_id) AS before FROM events)
 WHERE payload IS DISTINCT FROM before""")
def _(t):
    place = shared_path(t.spark, "revisions")
    E.run_once(KS.revisions(E.read_stream(t.spark, t.folder), "event_type", "1 day", 30), f"{place}/progress", f"{place}/rows")
    return t.spark.read.schema(KS.REVISIONS).parquet(f"{place}/rows")


def batches(t, parts: int = 3):
    """The events as a stream of micro-batches: the ids of each rest by `parts`, one file after the other, so that most days come late."""
    place = shared_path(t.spark, "arrivals")
    rows = t.raw("events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    for k in range(parts):
        rows.where(F.col("event_id") % parts == k).coalesce(1).write.mode("append").parquet(place)
    stream = t.spark.readStream.schema(E.SCHEMA).option("maxFilesPerTrigger", 1).parquet(place)
    return stream.select("user_id", F.to_date("ts").alias("day"), "event_id", (F.col("event_id") % parts).alias("arrival"), "value"), place


def merged_table(t, merge):
    stream, place = batches(t)
    path = shared_path(t.spark, "table")
    E.merge_batches(stream, f"{place}-progress", lambda batch, epoch: merge(batch, path, ["user_id", "day"], "day", ["arrival", "event_id"]))
    return shown(ST.read(t.spark, path, stream.schema).select("user_id", "day", "event_id", "value"))


@query("w01b_t09_stored_insert", shown_sql("SELECT user_id, cast(ts AS date) AS day, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY event_id % 3, event_id) = 1", ["user_id", "day", "event_id"], ["value"]))
def _(t):
    return merged_table(t, ST.insert_missing)


@query("w08b_stored_upsert", shown_sql("SELECT user_id, cast(ts AS date) AS day, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY event_id % 3 DESC, event_id DESC) = 1", ["user_id", "day", "event_id"], ["value"]))
def _(t):
    return merged_table(t, ST.upsert)
