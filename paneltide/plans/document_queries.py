"""Queries that unfold documents held as text, one row at a time."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneltide.functions import text as X
from paneltide.plans.registry import query, shown, shown_sql
from paneltide.sources import documents as D


@query("s07b_facts_from_text", shown_sql("""SELECT ticker, 'us-gaap' AS taxonomy, tag, 'USD' AS unit, start, "end", filed, val FROM facts WHERE "end" >= DATE '1997-01-01' AND hash_mod <> 0""".replace("hash_mod", "day(filed) % 9"), ["ticker", "taxonomy", "tag", "unit", "start", "end", "filed"], ["val"], 2), ["facts"])
def _(t):
    """Each fact as a document of its own; every ninth one is cut off, as a download that broke."""
    row = F.struct(*(F.col(c).cast("string").alias(c) for c in ("start", "end", "filed")), F.lit("10-Q").alias("form"), "val")
    units = F.struct(F.create_map(F.lit("USD"), F.array(row)).alias("units"))
    text = F.to_json(F.struct(F.create_map(F.lit("us-gaap"), F.create_map("tag", units)).alias("facts")))
    broken = F.day("filed") % 9 == 0
    docs = t.facts.select("ticker", F.when(broken, F.substring(text, 1, 40)).otherwise(text).alias("json"))
    return shown(D.facts_of(docs, since="1997-01-01"), "ticker", "taxonomy", "tag", "unit", "start", "end", "filed", "val", digits=2)


@query("s08b_filings_from_text", "SELECT ticker, form, filed, NULL::varchar AS items FROM filings UNION ALL SELECT ticker, '4' AS form, filed, 'x' AS items FROM filings", ["filings"])
def _(t):
    """A document per filing, with one array per column, of which the last is short."""
    recent = F.struct(F.array(F.lit("4"), "form").alias("form"), F.array(F.col("filed").cast("string"), F.col("filed").cast("string")).alias("filed"), F.array(F.lit("x")).alias("items"))
    docs = t.filings.select("ticker", F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings"))).alias("json"))
    return D.filings_of(docs, {"form": "string", "filed": "date", "items": "string"})


@query("x06b_sessions_of_spans", """SELECT m.ticker, m.start, m."end", d.date FROM membership m JOIN (SELECT DISTINCT date FROM panel) d ON d.date >= m.start AND (m."end" IS NULL OR d.date <= m."end")""", ["panel", "membership"])
def _(t):
    return D.sessions_of(t.membership, t.panel)


@query("s24b_atom_entries", """SELECT 'https://feeds/' || CASE WHEN user_id % 3 = 0 THEN 'merger' ELSE 'news' END AS source_url, event_type || ' & ' || event_id AS title, 'https://x/' || event_id AS link,
 CASE WHEN event_id % 2 = 0 THEN 'a  b' ELSE 'c' END || value AS summary, date_trunc('second', ts) AS published, CASE WHEN user_id % 3 = 0 THEN 'ma' ELSE 'news' END AS signal_type FROM events""")
def _(t):
    part = lambda tag, x, more="": F.concat(F.lit(f"<{tag}{more}>"), x, F.lit(f"</{tag}>"))
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    even = F.col("event_id") % 2 == 0
    text = F.concat(F.when(even, "&lt;p&gt;a &lt;b&gt;b").otherwise("c"), F.col("value").cast("string"), F.when(even, "&lt;/p&gt;").otherwise(""))
    links = F.concat(F.lit('<link rel="self" href="https://self"/><link href="https://x/'), "event_id", F.lit('"/>'))
    fields = [part("title", F.concat("event_type", F.lit(" &amp; "), "event_id")), links, F.when(even, part("summary", text)).otherwise(part("content", text)),
              F.when(even, part("published", at)).otherwise(part("updated", at))]
    url = F.concat(F.lit("https://feeds/"), F.when(F.col("user_id") % 3 == 0, "merger").otherwise("news"))
    feeds = t.raw("events").select(url.alias("source_url"), part("feed", part("entry", F.concat(*fields)), ' xmlns="http://www.w3.org/2005/Atom"').alias("xml"))
    return D.entries_of(feeds).withColumn("published", F.col("published").cast("timestamp_ntz"))


#: What a manager's reply says, by the remainder of an event's id; the SQL knows what must be read from it.
REPLIES = {
    0: ("VERDICT: APPROVE\nFINAL DECISION: BUY\nFINAL CONVICTION: HIGH\nREASON: momentum", "APPROVE", "BUY", "HIGH"),
    1: ("verdict - **adjust**\nfinal decision - **sell**\nfinal conviction: medium", "ADJUST", "SELL", "MEDIUM"),
    2: ("The final decision is, after much thought, to hold; final conviction (given all) low", "ADJUST", "HOLD", "LOW"),
    3: ("no tags at all", "ADJUST", "HOLD", "LOW"),
    4: ("VERDICT: REJECT\nFINAL DECISION: BUY\nFINAL CONVICTION: HIGH", "REJECT", "HOLD", "LOW"),
    5: ("VERDICT: UNSURE, but approve\nFINAL DECISION: MAYBE, rather sell\nFINAL CONVICTION: some, so medium", "APPROVE", "SELL", "MEDIUM"),
    6: ("FINAL DECISION: and now comes a sentence of far more than forty characters: BUY", "ADJUST", "HOLD", "LOW"),
}


@query("x03b_final_decisions", "SELECT event_id, " + ", ".join(
    f"CASE event_id % 7 {' '.join(f'WHEN {k} THEN {v[i]!r}' for k, v in REPLIES.items())} END AS {name}" for i, name in enumerate(("verdict", "action", "conviction"), 1)
) + " FROM events")
def _(t):
    said = F.element_at(F.create_map(*(F.lit(x) for k, v in REPLIES.items() for x in (k, v[0]))), (F.col("event_id") % 7).cast("int"))
    return t.raw("events").select("event_id", X.final_decision(said).alias("d")).select("event_id", "d.*")


KEYS = ["analyst_market", "bull_2", "bear_1", "risk_aggressive_round1", "research_manager", "trader", "portfolio_manager", "other", "risk_neutral"]
AGENTS = ["market", "bull", "bear", "risk_aggressive", "manager", "trader", "pm", None, "risk_neutral"]


@query("x03c_transcript_agents", f"""SELECT event_id, CASE event_id % 9 {' '.join(f"WHEN {k} THEN '{a}'" for k, a in enumerate(AGENTS) if a)} END AS agent,
 CASE WHEN event_id % 11 = 0 THEN 'n/a' ELSE printf('%+.1f%%', floor(value * 10) / 10 + 0.0) END AS moved FROM events""")
def _(t):
    key = F.element_at(F.array(*map(F.lit, KEYS)), (F.col("event_id") % 9 + 1).cast("int"))
    moved = F.when(F.col("event_id") % 11 != 0, F.floor(F.col("value") * 10) / 1000)
    return t.raw("events").select("event_id", X.agent_of(key).alias("agent"), X.signed_percent(moved).alias("moved"))


@query("x04b_reply_lists", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'What of ' || event_id || '?|And "why"?' WHEN 1 THEN 'Question number ' || event_id || '|Second question ' || event_type ELSE 'not [valid json at all' END AS questions,
 'Revenue rose by ' || event_id || '|Costs were cut in ' || event_type AS highlights, CASE WHEN event_id % 2 = 0 THEN 'high' ELSE 'medium' END AS severity FROM events""")
def _(t):
    k, kind = F.col("event_id"), F.col("event_type")
    array = F.concat(F.lit('Here you are:\n["What of '), k, F.lit('?", "And \\"why\\"?"]\nDone.'))
    lines = F.concat(F.lit("1. Question number "), k, F.lit("\nshort\n  2.- Second question "), kind, F.lit("  \n"))
    reply = F.when(k % 3 == 0, array).when(k % 3 == 1, lines).otherwise("not [valid json at all")
    points = F.concat(F.lit("Highlights\n• Revenue rose by "), k, F.lit("\n - * Costs were cut in "), kind, F.lit("\n\n-- \n"))
    risks = F.when(k % 2 == 0, F.concat(F.lit('Risks: {"severity": "high", "n": '), k, F.lit("} end"))).otherwise("none {broken")
    usual = F.try_parse_json(F.lit('{"severity": "medium"}'))
    return t.raw("events").select(
        "event_id", F.array_join(X.listed(reply), "|").alias("questions"), F.array_join(X.bullets(points), "|").alias("highlights"),
        F.try_variant_get(X.object_or(risks, usual), "$.severity", "string").alias("severity"),
    )
