"""The same logic on streams: latest quotes, bars, exits with a cooldown, alerts that fire once, headlines and sentiment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import news
from barloom.sources.shared import shared_path
from barloom.streaming import ordered


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file or folder as a stream, with the schema of what is there. As a pattern the path may be either."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def ticks(events: DataFrame) -> DataFrame:
    """Event rows as ticks; times without a zone are read as UTC."""
    rows = events.where("value IS NOT NULL AND value <> 0")
    return rows.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("px"), F.col("event_id").alias("seq"))


def latest_quotes(quotes: DataFrame) -> DataFrame:
    """The newest tick per symbol (complete or update mode)."""
    return quotes.groupBy("symbol").agg(F.max_by(F.struct("ts", "px"), F.struct("ts", "seq")).alias("q")).select("symbol", "q.*")


def stream_bars(quotes: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bars of closed windows (append mode); ticks later than the watermark are dropped."""
    order = F.struct("ts", "seq")
    return (
        quotes.withWatermark("ts", late)
        .groupBy("symbol", F.window("ts", width).alias("w"))
        .agg(F.min_by("px", order).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", order).alias("close"), F.count("*").alias("ticks"))
        .select("symbol", F.col("w.start").alias("bar"), "open", "high", "low", "close", "ticks")
    )


def exits(quotes: DataFrame, positions: DataFrame, cooldown_ms: int = 60_000, sells: DataFrame | None = None, late: str = "10 minutes") -> DataFrame:
    """An exit when a price leaves a position's bracket (portfolio, symbol, stop, target), then none during the cooldown (append mode).

    A stream of ``sells`` by hand (portfolio, symbol, ts) starts the cooldown too. Both are taken in the order of events: an exit is told when the watermark
    has passed it. The static side is joined by symbol.
    """
    hits = quotes.withWatermark("ts", late).join(positions, "symbol").where((F.col("px") <= F.col("stop")) | (F.col("px") >= F.col("target")))
    reason = F.when(F.col("px") <= F.col("stop"), "STOP").otherwise("TARGET")
    rows = hits.select("portfolio", "symbol", "ts", F.unix_micros("ts").alias("at"), F.col("seq").cast("long").alias("seq"), "px", reason.alias("reason"))
    if sells is not None:
        sold = sells.withWatermark("ts", late).select("portfolio", "symbol", "ts", F.unix_micros("ts").alias("at"), F.lit(-1).cast("long").alias("seq"), F.lit(None).cast("double").alias("px"), F.lit(None).cast("string").alias("reason"))
        rows = rows.unionByName(sold)
    made = ordered.run(rows, ["portfolio", "symbol"], ordered.Exits(cooldown_ms), ordered.Exits.OUT)
    return made.select("portfolio", "symbol", F.timestamp_micros("at").alias("ts"), "px", "reason")


def alerts(quotes: DataFrame, wanted: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each alert (alert, symbol, level, condition) fires once, at the first price that meets it in the order of events (append mode)."""
    met = F.when(F.col("condition") == "ABOVE", F.col("px") >= F.col("level")).otherwise(F.col("px") <= F.col("level"))
    rows = quotes.withWatermark("ts", late).join(wanted, "symbol").where(met).select("alert", "ts", F.unix_micros("ts").alias("at"), F.col("seq").cast("long").alias("seq"), "px")
    return ordered.run(rows, ["alert"], ordered.Alerts(), ordered.Alerts.OUT).select("alert", F.timestamp_micros("at").alias("ts"), "px")


def ledger(orders: DataFrame, cash: float = 1_000_000.0, late: str = "1 day", shares: int | None = None) -> DataFrame:
    """Where each portfolio stands after every batch in which it traded, with all orders known so far executed in the order of events (append mode).

    Orders (portfolio, symbol, ts, side, qty, price, seq_key) are final, and only then in the state for good, when the watermark has passed them. Of a
    portfolio's rows the one of the highest ``version`` is the latest. Orders without a portfolio are left out.

    The state is kept by portfolio, or by ``shares`` of them that stay the same for a checkpoint: a batch in which most portfolios trade then spends far less on
    each, but it reads all that waits in a share in which one trades.
    """
    key = F.col("portfolio") if shares is None else F.pmod(F.xxhash64("portfolio"), F.lit(shares))
    rows = orders.where("portfolio IS NOT NULL").withWatermark("ts", late).select(key.alias("share"), "portfolio", "ts", F.unix_micros("ts").alias("at"), F.col("seq_key").alias("seq"), "symbol", "side", F.col("qty").cast("long").alias("qty"), F.col("price").cast("double").alias("price"))
    return ordered.run(rows, ["share"], ordered.Ledger(cash), ordered.Ledger.OUT)


def latest_standing(standings: DataFrame) -> DataFrame:
    """The last row of each portfolio of :func:`ledger`."""
    rest = F.struct("cash", "positions", "accepted", "rejected")
    return standings.groupBy("portfolio").agg(F.max_by(rest, "version").alias("r")).select("portfolio", "r.*")


def stream_headlines(headlines: DataFrame, late: str = "1 day") -> DataFrame:
    """Classified headlines, each url once (append mode)."""
    return news.classify(headlines.withWatermark("ts", late).dropDuplicatesWithinWatermark(["url"]))


def stream_sentiment(headlines: DataFrame, universe: DataFrame, width: str = "24 hours", slide: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """Each symbol's score and number of headlines over closed sliding windows (append mode). The universe is a table."""
    met = news.mentions(news.classify(headlines.withWatermark("ts", late)), universe)
    sums = met.groupBy("symbol", F.window("ts", width, slide).alias("w")).agg(F.sum("points").alias("sum"), F.count("*").alias("news"))
    scored = sums.select("symbol", F.col("w.start").alias("start"), news.clamped("sum").alias("score"), "news")
    return scored.withColumn("label", news.label())


def stream_activity(quotes: DataFrame, width: str = "24 hours", slide: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """Sliding sums per symbol over closed windows (append mode)."""
    sums = quotes.withWatermark("ts", late).groupBy("symbol", F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("n"), F.sum("px").alias("total"))
    return sums.select("symbol", F.col("w.start").alias("start"), "n", "total")


def drained(stream: DataFrame, label: str, mode: str = "append", polled: bool = False) -> DataFrame:
    """All that ``stream`` yields for what its source holds now, by way of the shared folder. A ``polled`` source is asked until it has nothing new."""
    spark = stream.sparkSession
    out = shared_path(spark, label)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{'all' if mode == 'complete' else number}")

    writer = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", shared_path(spark, f"{label}-log"))
    if polled:
        query = writer.start()
        query.processAllAvailable()
        query.stop()
    else:
        query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/*")
