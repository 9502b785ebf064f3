"""Scalar functions on strings, JSON replies and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_text(html: Column, most: int = 2000) -> Column:
    """Tags become spaces; trimmed and cut."""
    return F.substring(F.trim(F.regexp_replace(html, "<[^>]+>", " ")), 1, most)


def signal_kind(source: Column, title: Column) -> Column:
    """8-K filings first, then mergers by the source's name or words of the title, else news."""
    low, where = F.lower(F.coalesce(title, F.lit(""))), F.lower(source)
    merger = where.contains("merger") | low.rlike("acqui|merger|deal|takeover|buyout")
    return F.when(where.contains("8-k") | low.contains("8-k"), "sec_8k").when(merger, "ma").otherwise("news")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-z]+://([^/:]+)", 1))


def score_reply(reply: Column) -> Column:
    """The whole-number score of a JSON object in a reply (50 where the object has none).

    Without such an object, the first number of up to three digits that stands alone, else 50; from 0 to 100.
    """
    found = F.nullif(F.regexp_extract(reply, r"\{[\s\S]*\}", 0), F.lit(""))
    parsed = F.try_parse_json(found)
    given = F.try_variant_get(parsed, "$.score", "string")
    whole = F.when(given.isNull(), 50.0).otherwise(F.signum(given.try_cast("double")) * F.floor(F.abs(given.try_cast("double"))))
    number = F.nullif(F.regexp_extract(reply, r"\b([0-9]{1,3})\b", 1), F.lit("")).cast("double")
    score = F.coalesce(F.when(parsed.isNotNull(), whole), number, F.lit(50.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def tag_value(text: Column, name: str, usual: str) -> Column:
    """Value behind `NAME:` in a reply, upper case; the usual one where there is none."""
    return F.coalesce(F.nullif(F.upper(F.regexp_extract(text, rf"(?i){name}\s*:\s*([A-Za-z_]+)", 1)), F.lit("")), F.lit(usual))


def ticker_symbol(raw: Column, renames: dict[str, str] | None = None) -> Column:
    made = F.regexp_replace(F.upper(F.trim(raw)), r"\.", "-")
    if renames:
        made = F.coalesce(F.create_map(*(F.lit(x) for pair in renames.items() for x in pair))[made], made)
    return made


def padded_cik(cik: Column) -> Column:
    return F.lpad(F.ltrim(cik.cast("string"), F.lit("0")), 10, "0")


def percent(x: Column) -> Column:
    return F.concat(F.when(x >= 0, "+").otherwise("-"), F.format_string("%.1f%%", F.abs(x) * 100))


def action(score: Column) -> Column:
    return F.when(score >= 80, "pursue").when(score >= 60, "watch").when(score.isNotNull(), "pass")


def status(score: Column) -> Column:
    return F.when(score.isNull(), "Watch").when(score >= 70, "On Track").when(score >= 45, "Watch").otherwise("Alert")


def badge(score: Column) -> Column:
    return F.when(score >= 75, "green").when(score >= 50, "yellow").when(score.isNotNull(), "red")


def decision_weight(action_: Column, conviction: Column, previous: Column) -> Column:
    """BUY by conviction (LOW, MEDIUM, HIGH: 0.33, 0.66, 1), SELL none, HOLD what was there."""
    by = F.when(conviction == "HIGH", 1.0).when(conviction == "MEDIUM", 0.66).otherwise(0.33)
    return F.when(action_ == "BUY", by).when(action_ == "SELL", 0.0).otherwise(previous)


#: Ratios of usual splits: fixed values.
SPLITS = (2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0, 3 / 2, 4 / 3, 5 / 4)


def looks_like_split(ratio: Column, tolerance: float = 0.005) -> Column:
    """Whether a price ratio lies at a usual split, either way."""
    off = lambda k: F.least(F.abs(ratio * k - 1), F.abs(ratio / k - 1))
    return (ratio > 0) & F.exists(F.array(*map(F.lit, SPLITS)), lambda k: off(k) < tolerance)


def allowed_tag(text: Column, name: str, allowed: tuple[str, ...], usual: str) -> Column:
    """The value behind `NAME:` or `NAME -` (stars may stand before it), if it is an allowed word.

    Else the first allowed word, in their order, within 40 characters behind the name; else the usual one.
    """
    said = F.upper(F.regexp_extract(text, rf"(?i){name}\s*[:\-]\s*\**\s*([A-Z]+)", 1))
    near = [F.when(F.regexp_like(text, F.lit(rf"(?is){name}[^A-Za-z]*.{{0,40}}\b{word}\b")), word) for word in allowed]
    return F.coalesce(F.when(said.isin(*allowed), said), *near, F.lit(usual))


def final_decision(text: Column) -> Column:
    """verdict, action and conviction of a manager's reply; a rejected proposal is held with low conviction."""
    verdict = allowed_tag(text, "VERDICT", ("APPROVE", "ADJUST", "REJECT"), "ADJUST")
    action_ = allowed_tag(text, "FINAL DECISION", ("BUY", "HOLD", "SELL"), "HOLD")
    conviction = allowed_tag(text, "FINAL CONVICTION", ("LOW", "MEDIUM", "HIGH"), "LOW")
    rejected = verdict == "REJECT"
    return F.struct(
        verdict.alias("verdict"), F.when(rejected, "HOLD").otherwise(action_).alias("action"),
        F.when(rejected, "LOW").otherwise(conviction).alias("conviction"),
    )


def agent_of(key: Column) -> Column:
    """Which agent a key of a transcript belongs to; NULL for none."""
    return (
        F.when(key.startswith("analyst_"), F.regexp_replace(key, "^analyst_", ""))
        .when(key.startswith("bull_") | key.startswith("bear_"), F.substring_index(key, "_", 1))
        .when(key.startswith("risk_"), F.regexp_replace(key, "_round(?!.*_round).*$", ""))
        .when(key == "research_manager", "manager").when(key == "trader", "trader").when(key == "portfolio_manager", "pm")
    )


def _lines(text: Column, drop: str, most: int) -> Column:
    """Trimmed lines of more than ten characters, without what a pattern finds at their beginning."""
    trimmed = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    long_ones = F.filter(F.split(text, "\n"), lambda x: F.length(trimmed(x)) > 10)
    return F.slice(F.transform(long_ones, lambda x: trimmed(F.regexp_replace(x, drop, ""))), 1, most)


def bullets(text: Column, most: int = 6) -> Column:
    """The points of a list in a reply, without their marks."""
    return _lines(text, r"^[•\-* ]+", most)


def listed(text: Column, most: int = 15) -> Column:
    """The strings of a JSON array in a reply; where none can be read, its lines without numbers."""
    parsed = F.try_parse_json(F.nullif(F.regexp_extract(text, r"\[[\s\S]*\]", 0), F.lit("")))
    return F.coalesce(F.try_variant_get(parsed, "$", "array<string>"), _lines(text, r"^\s*[\d.\-*]+\s*", most))


def object_or(text: Column, usual: Column) -> Column:
    """The JSON object in a reply as a variant, or the usual one (a variant) where none can be read."""
    return F.coalesce(F.try_parse_json(F.nullif(F.regexp_extract(text, r"\{[\s\S]*\}", 0), F.lit(""))), usual)


def signed_percent(x: Column) -> Column:
    """One decimal with its sign; n/a for a value that is missing or not finite."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite, F.format_string("%+.1f%%", F.round(x * 100, 1) + F.lit(0.0))).otherwise("n/a")
