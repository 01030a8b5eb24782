"""Readers and writers of bars, ledgers, model documents and relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.sources import versioned

#: Files of a year: its symbols are dealt to so many tasks.
PARTS = 16
#: Fields of a model document.
MANIFEST = (
    "version string, type string, trainEnd string, validationEnd string, testEnd string, calibrationKnots array<array<double>>, "
    "empiricalDistributions array<struct<horizon: string, probLower: double, probUpper: double, bucketType: string, meanGainConditionalUp: double, "
    "meanLossConditionalDown: double, sampleCount: bigint>>"
)


def write_bars(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Bars by year, clustered by symbol: a year's folder is pruned by date filters, a symbol's rows stand together.

    Only the years written are replaced.
    """
    by_year = bars.withColumn("year", F.year("bar"))
    writer = by_year.repartition("year", F.pmod(F.xxhash64("symbol"), F.lit(PARTS))).sortWithinPartitions("symbol", "bar").write.partitionBy("year").mode(mode)
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def write_bucketed(bars: DataFrame, name: str, path: str, buckets: int = PARTS) -> DataFrame:
    """Bars as a table bucketed and sorted by symbol: windows over a symbol read it without an exchange. The table is read back."""
    dealt = bars.repartition(buckets, "symbol").sortWithinPartitions("symbol", "bar")
    dealt.write.bucketBy(buckets, "symbol").sortBy("symbol", "bar").option("path", path).mode("overwrite").saveAsTable(name)
    return bars.sparkSession.table(name)


def append_bars(bars: DataFrame, path: str) -> None:
    """Only bars that aren't stored yet."""
    stored = bars.sparkSession.read.parquet(path).select("symbol", "bar")
    write_bars(bars.join(stored, ["symbol", "bar"], "left_anti"), path, "append")


def scan_bars(spark: SparkSession, path: str, least: int = 200, excluded: list[str] = ()) -> DataFrame:
    """Stored bars of symbols that aren't excluded and have at least ``least`` bars."""
    bars = spark.read.parquet(path).where(~F.col("symbol").isin(list(excluded)) if excluded else F.lit(True))
    long = bars.groupBy("symbol").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("symbol")
    return bars.join(long, "symbol", "left_semi").drop("year")


def scan_symbol_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Bars kept in one file per symbol: the symbol is the file's name."""
    return spark.read.parquet(pattern).withColumn("symbol", F.regexp_extract("_metadata.file_name", r"^(.*)\.parquet$", 1))


def scan_manifests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Knots and buckets of model documents, one row each."""
    docs = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    knots = docs.select("version", F.posexplode("calibrationKnots").alias("place", "k")).select("version", "place", F.get("k", F.lit(0)).alias("x"), F.get("k", F.lit(1)).alias("y"))
    return knots, docs.select("version", F.explode("empiricalDistributions").alias("b")).select("version", "b.*")


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Predictions (symbol, bar, horizon, prob) by year of their bar."""
    predictions.withColumn("year", F.year("bar")).repartition("year", F.pmod(F.xxhash64("symbol"), F.lit(PARTS))).write.partitionBy("year").mode("append").parquet(path)


def resolve_predictions(stored: DataFrame, panel: DataFrame, horizons: dict[str, int]) -> DataFrame:
    """Stored predictions with what came of them: the horizon's return, whether the direction was right, and the bar that tells; null while open."""
    ws = Window.partitionBy("symbol").orderBy("bar")
    ahead = panel.withColumns({f"_o_{h}": F.struct(F.lit(h).alias("horizon"), (F.lead("close", n).over(ws) / F.col("close") - 1).alias("actual_return"), F.lead("bar", n).over(ws).alias("resolved_at")) for h, n in horizons.items()})
    outcomes = ahead.select("symbol", "bar", F.explode(F.array(*[f"_o_{h}" for h in horizons])).alias("o")).select("symbol", "bar", "o.*")
    joined = stored.drop("year").join(outcomes, ["symbol", "bar", "horizon"], "left")
    return joined.withColumn("correct", ((F.col("prob") >= 0.5) == (F.col("actual_return") > 0)).cast("int"))


#: Columns of stored predictions that may be resolved later.
PREDICTIONS = "symbol string, bar date, horizon string, prob double, actual_return double, resolved_at date, correct int"


def record_predictions(predictions: DataFrame, path: str) -> list[int]:
    """Predictions (symbol, bar, horizon, prob) into a table of years (:mod:`barloom.sources.versioned`), open; the years that were written."""
    none = F.lit(None)
    opened = predictions.select("symbol", "bar", "horizon", "prob", none.cast("double").alias("actual_return"), none.cast("date").alias("resolved_at"), none.cast("int").alias("correct"))
    return versioned.upsert(opened, path, ["symbol", "bar", "horizon"], F.year("bar"), F.col("resolved_at").isNull())


def resolve_open(panel: DataFrame, path: str, horizons: dict[str, int]) -> list[int]:
    """Fill in what has come of open predictions by the panel's bars; only years that hold open ones are read, only those in which some are told are written."""
    spark = panel.sparkSession
    years = versioned.open_parts(spark, path)
    waiting = versioned.scan(spark, path, PREDICTIONS, years).where("resolved_at IS NULL")
    told = resolve_predictions(waiting.select("symbol", "bar", "horizon", "prob").withColumn("year", F.year("bar")), panel, horizons)
    return versioned.upsert(told.where("resolved_at IS NOT NULL").select([x.split()[0] for x in PREDICTIONS.split(", ")]), path, ["symbol", "bar", "horizon"], F.year("bar"), F.col("resolved_at").isNull())


def export_ledger(trades: DataFrame, path: str, zone: str = "Asia/Kolkata") -> None:
    """A quoted CSV of trades with the exchange's local time."""
    shown = trades.withColumn("local_time", F.date_format(F.from_utc_timestamp("ts", zone), "yyyy-MM-dd HH:mm:ss"))
    shown.write.option("header", True).option("quoteAll", True).option("escape", '"').mode("overwrite").csv(path)


def scan_relational(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int) -> DataFrame:
    """A relational table in parallel ranges of a numeric column; filters are pushed down."""
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts)
