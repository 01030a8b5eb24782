"""Cleaning, normalising and checking of raw candles, quotes and tickers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRICES = ["open", "high", "low", "close"]


def cents(x: Column) -> Column:
    """Two decimals, halves away from zero, of a price taken to six decimals first."""
    return F.round(x.cast("decimal(20,6)"), 2).cast("double")


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text to doubles; what isn't a number becomes null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def drop_null_ohlc(df: DataFrame) -> DataFrame:
    return df.dropna(subset=PRICES)


def valid_candles(df: DataFrame, time: str = "time") -> DataFrame:
    return drop_null_ohlc(df).where(F.col(time).isNotNull() & (F.col("high") >= F.col("low")))


def dedupe_candles(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The first row of each key by ``seq``. An aggregation, so copies are dropped before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c != seq]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), seq).alias("_row")).select(*keys, "_row.*")


def round_prices(df: DataFrame) -> DataFrame:
    return df.withColumns({c: cents(F.col(c)) for c in PRICES})


def clean_candles(raw: DataFrame, keys: list[str], seq: str) -> DataFrame:
    return round_prices(dedupe_candles(valid_candles(coerce_numeric(raw, [*PRICES, "volume"]), keys[-1]), keys, seq))


def min_history(df: DataFrame, least: int, symbol: str = "symbol") -> DataFrame:
    """Rows of symbols with at least ``least`` rows, by a semi-join on the counts."""
    long = df.groupBy(symbol).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return df.join(long.select(symbol), symbol, "left_semi")


def exclude_symbols(df: DataFrame, excluded: DataFrame, symbol: str = "symbol") -> DataFrame:
    return df.join(excluded.select(symbol), symbol, "left_anti")


def ohlc_anomalies(candles: DataFrame, time: str) -> DataFrame:
    """Violations per symbol. Rows are ordered by ``seq`` as they came, times should ascend and be unique."""
    before = F.lag(time).over(Window.partitionBy("symbol").orderBy("seq"))
    o, h, lo, c = (F.col(x) for x in PRICES)
    flags = {
        "high_too_low": h < F.greatest(o, c, lo),
        "low_too_high": lo > F.least(o, c, h),
        "price_not_positive": F.least(o, h, lo, c) <= 0,
        "not_ascending": F.col(time) <= before,
        "zero_volume": F.col("volume") == 0,
        "missing": o.isNull() | h.isNull() | lo.isNull() | c.isNull(),
    }
    flagged = candles.select("symbol", *[F.coalesce(f, F.lit(False)).cast("long").alias(n) for n, f in flags.items()])
    return flagged.groupBy("symbol").agg(F.count("*").alias("candles"), *[F.sum(n).alias(n) for n in flags])


def normalize_ticker(raw: Column) -> Column:
    t = F.upper(F.trim(raw))
    return F.when(t.startswith("^") | t.endswith(".NS") | t.endswith(".BO"), t).when(t == "", t).otherwise(F.concat(t, F.lit(".NS")))


def session_status(utc: Column, zone: str = "Asia/Kolkata") -> Column:
    """The exchange's session at a UTC time: closed at weekends, pre-open from 9:00, open from 9:15 to 15:30."""
    local = F.from_utc_timestamp(utc, zone)
    minute = F.hour(local) * 60 + F.minute(local)
    return (
        F.when(F.dayofweek(local).isin(1, 7), "CLOSED")
        .when((minute >= 540) & (minute < 555), "PRE_OPEN")
        .when((minute >= 555) & (minute <= 930), "OPEN")
        .otherwise("CLOSED")
    )


def normalize_quotes(raw: DataFrame, status: Column) -> DataFrame:
    """Quotes with a price: changes, widened day range, cents, default volume and freshness by the session."""
    price = F.col("price")
    before = F.coalesce(F.nullif("prev_close", F.lit(0.0)), price)
    change = price - before
    return raw.where("price > 0").select(
        normalize_ticker(F.col("symbol")).alias("ticker"),
        cents(price).alias("price"),
        cents(change).alias("change"),
        cents(F.when(before > 0, change / before * 100).otherwise(0.0)).alias("change_percent"),
        cents(F.greatest(F.coalesce(F.nullif("high", F.lit(0.0)), price), price, before)).alias("day_high"),
        cents(F.least(F.coalesce(F.nullif("low", F.lit(0.0)), price), price, before)).alias("day_low"),
        cents(before).alias("prev_close"),
        cents(F.coalesce(F.nullif("open", F.lit(0.0)), before)).alias("open"),
        F.coalesce(F.nullif("volume", F.lit(0.0)), F.lit(100000.0)).alias("volume"),
        F.when(status == "OPEN", "LIVE").when(status == "PRE_OPEN", "DELAYED").otherwise("CLOSED").alias("freshness"),
    )


def upsert_dimension(target: DataFrame, source: DataFrame, key: str, order: str) -> DataFrame:
    """``target`` with the rows of ``source`` (the first of each key) put in or written over."""
    rest = [c for c in target.columns if c != key]
    first = source.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_new"))
    joined = target.select(key, F.struct(*rest).alias("_old")).join(first, key, "full")
    return joined.select(key, *[F.coalesce(F.col(f"_new.{c}"), F.col(f"_old.{c}")).alias(c) for c in rest])


def feed_items(pages: DataFrame, page: str, html: str, item: str, title: str, link: str) -> DataFrame:
    """Items of raw payloads with title and link, by patterns; items that lack one are dropped."""
    items = pages.select(page, F.posexplode(F.regexp_extract_all(html, F.lit(item), F.lit(1))).alias("position", "item"))
    taken = items.select(
        page,
        "position",
        F.trim(F.regexp_replace(F.regexp_extract("item", title, 1), r"<!\[CDATA\[(.*?)\]\]>", "$1")).alias("title"),
        F.trim(F.regexp_extract("item", link, 1)).alias("link"),
    )
    return taken.where("title <> '' AND link <> ''")
