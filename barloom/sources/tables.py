"""The engine's tables, derived from a warehouse of orders, parts, events, documents and pages.

Each function takes (spark, sf_dir) and returns a lazy DataFrame. Rows are reduced to bars before any window over a symbol.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Orders rows of one symbol and time fully; ``(l_orderkey, l_linenumber)`` alone isn't unique.
SEQ = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices and quantities by symbol (a part's brand)."""
    lines = table(spark, sf_dir, "lineitem").select(*SEQ, "l_quantity", "l_returnflag")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("symbol"),
        "l_shipdate",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
        F.col("l_quantity").alias("qty"),
        F.struct(*SEQ).alias("seq"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of each symbol."""
    ticks = trades(spark, sf_dir).withColumn("bar", F.to_date(F.date_trunc("week", F.col("l_shipdate"))))
    return to_bars(ticks, ["symbol", "bar"], "px", "qty", "seq")


def to_bars(ticks: DataFrame, keys: list[str], px: str, qty: str, seq: str) -> DataFrame:
    """Open, high, low, close and volume by ``keys``; one shuffle, with partial aggregation before it."""
    return ticks.groupBy(*keys).agg(
        F.min_by(px, seq).alias("open"),
        F.max(px).alias("high"),
        F.min(px).alias("low"),
        F.max_by(px, seq).alias("close"),
        F.sum(qty).alias("volume"),
    )


def benchmark(panel: DataFrame) -> DataFrame:
    """The mean close per bar over all symbols. The mean is taken of exact decimals, so it doesn't hang on the order of rows."""
    return panel.groupBy("bar").agg(F.round(F.avg(F.col("close").cast("decimal(18,8)")).cast("double"), 6).alias("bclose"))


def vix(bench: DataFrame) -> DataFrame:
    """A stand-in for a volatility index: 100 times the 20-bar volatility of the benchmark. One row per bar."""
    order = Window.partitionBy(F.lit(0)).orderBy("bar")
    returns = bench.withColumn("r", F.col("bclose") / F.lag("bclose").over(order) - 1)
    value = F.when(F.count("r").over(order.rowsBetween(-19, 0)) >= 20, 100 * F.stddev_samp("r").over(order.rowsBetween(-19, 0)))
    return returns.select("bar", value.alias("value"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("value IS NOT NULL AND value <> 0")
    return events.select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("px"), F.lit(1.0).alias("qty"), F.col("event_id").alias("seq")
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of buys and sells: one portfolio per customer."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("o_custkey").alias("portfolio"),
            F.col("p_brand").alias("symbol"),
            F.col("l_shipdate").cast("timestamp").alias("ts"),
            F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
            F.col("l_quantity").cast("int").alias("qty"),
            (F.col("l_extendedprice") / F.col("l_quantity")).cast("decimal(18,4)").cast("decimal(14,2)").alias("price"),
            F.struct(*SEQ).alias("seq"),
        )
    )


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per symbol, ranked by name: a bounded dimension."""
    parts = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_name").alias("name"), F.min(F.split("p_type", " ")[0]).alias("sector"))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("p_brand"))
    ranked = parts.select(rank.alias("rank"), F.col("p_brand").alias("symbol"), "name", "sector")
    return ranked.withColumn("tier", F.when(F.col("rank") <= 8, "LARGE").when(F.col("rank") <= 16, "MID").otherwise("SMALL"))


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as news: the whole text is searched for words."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("title"),
        F.col("source").alias("source"),
        F.concat(F.lit("https://news.example/"), F.col("source"), F.lit("/"), F.col("doc_id")).alias("url"),
    )


def quotes(panel: DataFrame) -> DataFrame:
    """The latest bar of each symbol as a quote, with the close before it."""
    before = Window.partitionBy("symbol").orderBy("bar")
    last = panel.withColumn("prev_close", F.lag("close").over(before)).groupBy("symbol").agg(
        F.max_by(F.struct("bar", "open", "high", "low", "close", "volume", "prev_close"), "bar").alias("q")
    )
    return last.select("symbol", "q.*").withColumnRenamed("close", "price")
