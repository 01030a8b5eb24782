"""Headlines: source, category, sentiment, impact and scores per symbol."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import let
from barloom.operators.joins import containing

#: Keywords by category in order of precedence, of sentiment, and by impact.
CATEGORIES = {
    "Macro": ["rbi", "inflation", "gdp", "fed", "deficit", "rupee", "repo"],
    "Results": ["q1", "q2", "q3", "q4", "profit", "revenue", "earnings", "pat", "ebitda"],
    "Markets": ["sensex", "nifty", "rally", "stocks to watch", "fii", "dii", "bull", "bear"],
}
POSITIVE = [
    "surge", "jump", "gain", "rally", "profit", "boost", "growth", "beats", "soar", "record", "upgrade", "expansion", "breakout", "buyback",
    "dividend", "acquisition", "outperform", "bullish", "turnaround", "milestone", "robust", "optimistic",
]
NEGATIVE = [
    "fall", "drop", "slump", "crash", "loss", "decline", "plunge", "penalty", "probe", "downgrade", "weak", "drag", "fraud", "default",
    "bankruptcy", "scam", "selloff", "bearish", "warning", "layoff", "recall", "miss", "underperform", "investigation",
]
IMPACT = {
    "HIGH": ["rbi", "sebi", "merger", "acquisition", "results", "huge", "investigation"],
    "MEDIUM": ["order", "partnership", "dividend", "target"],
}
EVENTS = {
    "EARNINGS": ["q1", "q2", "q3", "q4", "profit", "revenue", "ebitda", "earnings"],
    "REGULATORY": ["sebi", "rbi", "court", "tax", "penalty", "probe"],
    "MACRO": ["inflation", "gdp", "crude", "fed", "rate hike"],
    "CORPORATE": ["merger", "acquisition", "stake", "order", "deal"],
}


def first_of(text: Column, sets: dict[str, list[str]], other: str) -> Column:
    """The first set one of whose words stands anywhere in the text."""
    out = None
    for name, words in sets.items():
        hit = reduce(Column.__or__, [text.contains(x) for x in words])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other)


def hits(text: Column, words: list[str]) -> Column:
    return sum((text.contains(x).cast("int") for x in words), F.lit(0))


def split_source(title: Column, source: Column) -> tuple[Column, Column]:
    """Title and source of "Headline - Source": the part after the last dash is the source."""
    parts = F.split(title, " - ")
    several = F.size(parts) > 1
    head = F.trim(F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), " - "))
    return F.when(several, head).otherwise(title), F.when(several, F.coalesce(F.nullif(F.trim(F.element_at(parts, -1)), F.lit("")), source)).otherwise(source)


def classify(headlines: DataFrame) -> DataFrame:
    """``headlines`` (title, source, url) with source split off, category, sentiment, impact and keys."""
    title, source = split_source(F.col("title"), F.col("source"))
    df = headlines.withColumns({"title": title, "source": source})

    def told(t: Column) -> Column:
        marks = F.struct(hits(t, POSITIVE).alias("plus"), hits(t, NEGATIVE).alias("minus"))
        mood = let(marks, lambda m: F.when(m["plus"] > m["minus"], "POSITIVE").when(m["minus"] > m["plus"], "NEGATIVE").otherwise("NEUTRAL"))
        return F.struct(first_of(t, CATEGORIES, "Corporate").alias("category"), mood.alias("sentiment"), first_of(t, IMPACT, "LOW").alias("impact"))

    keys = {"article_id": F.concat(F.lit("news_"), F.substring(F.base64(F.encode("url", "UTF-8")), 1, 16)), "url_key": F.sha2("url", 256)}
    # a text is lower-cased once for all its words
    return df.withColumn("_told", let(F.coalesce(F.lower("title"), F.lit("")), told)).withColumns({c: F.col(f"_told.{c}") for c in ("category", "sentiment", "impact")} | keys).drop("_told")


def time_ago(published: Column, now: Column) -> Column:
    minutes = F.floor((F.unix_timestamp(now) - F.unix_timestamp(published)) / 60)
    return (
        F.when(minutes < 1, "Just now")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d ago")))
    )


def symbol_sentiment(classified: DataFrame, universe: DataFrame) -> DataFrame:
    """A score of -20 to 20 per symbol: headlines that name it weigh more than those that name its sector. Hits are summed before the shuffle."""
    sums = mentions(classified, universe).groupBy("symbol").agg(F.sum("points").alias("sum"), F.count("*").alias("news"), F.min("id").alias("first"))
    # one headline for each symbol is fetched, so that no text goes through the sums
    first = sums.join(classified.select(F.col("id").alias("first"), F.col("title").alias("headline")), "first").select("symbol", "headline")
    told = sums.join(first, "symbol", "left")
    out = universe.select("symbol").join(told, "symbol", "left").select("symbol", clamped("sum").alias("score"), F.coalesce("news", F.lit(0)).alias("news"), "headline")
    return structured(out.withColumn("label", label()))


def clamped(total: str) -> Column:
    return F.greatest(F.lit(-20), F.least(F.lit(20), F.coalesce(total, F.lit(0)))).cast("long")


def label() -> Column:
    return F.when(F.col("score") >= 4, "BULLISH").when(F.col("score") <= -4, "BEARISH").otherwise("NEUTRAL")


def mentions(classified: DataFrame, universe: DataFrame) -> DataFrame:
    """``classified`` headlines by the symbols they name or whose sector they name, with the points that each counts."""
    words = [(F.lower("symbol"), 3), (F.lower(F.split("name", " ")[0]), 4), (F.lower("sector"), 3)]
    met = containing(classified, universe, "symbol", words)
    direct = F.col("_kind") < 2
    weight = F.when(direct, F.when(F.col("impact") == "HIGH", 8).when(F.col("impact") == "MEDIUM", 5).otherwise(3)).otherwise(F.when(F.col("impact") == "HIGH", 3).otherwise(2))
    sign = F.when(F.col("sentiment") == "POSITIVE", 1).when(F.col("sentiment") == "NEGATIVE", -1).otherwise(0)
    return met.withColumn("points", weight * sign).drop("_kind")


def structured(scored: DataFrame) -> DataFrame:
    """Score and headline as levels of sentiment, severity and kind of event."""
    s, size = F.col("score"), F.abs("score")
    level = F.when(s >= 25, "VERY_BULLISH").when(s >= 8, "BULLISH").when(s <= -25, "VERY_BEARISH").when(s <= -8, "BEARISH").otherwise("NEUTRAL")
    severity = F.when(size >= 35, "CRITICAL").when(size >= 20, "HIGH").when(size >= 10, "MEDIUM").when(size > 0, "LOW").otherwise("NONE")
    return scored.withColumns({"level": level, "severity": severity, "event": first_of(F.lower(F.coalesce("headline", F.lit(""))), EVENTS, "GENERAL")})
