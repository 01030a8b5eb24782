"""Costs, forward returns and labels, liquidity, regimes, partitions and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.features import YEAR, ws

HORIZONS = {"1d": 1, "5d": 5, "20d": 20}
#: Brokerage, tax on sells, exchange, tax on charges, stamp duty on buys, regulator, slippage in basis points.
COST_REGIMES = {
    "LOW_COST": (0.0001, 0.0010, 0.00003, 0.18, 0.00015, 0.000001, 2.0),
    "BASE_COST": (0.0003, 0.0010, 0.0000345, 0.18, 0.00015, 0.000001, 5.0),
    "HIGH_COST": (0.0005, 0.0010, 0.0000345, 0.18, 0.00015, 0.000001, 10.0),
}


def round_trip_cost(regime: str = "BASE_COST") -> float:
    """Charges of buying and selling as a share of the value: both sides bear broker, exchange, tax, regulator and slippage."""
    brokerage, on_sell, exchange, tax, on_buy, regulator, slippage = COST_REGIMES[regime]
    return 2 * ((brokerage + exchange) * (1 + tax) + regulator + slippage / 10_000) + on_buy + on_sell


def by_cost_regime(df: DataFrame) -> DataFrame:
    """Each row once per cost regime, with its round-trip ``cost``."""
    regimes = F.array(*[F.struct(F.lit(name).alias("regime"), F.lit(round_trip_cost(name)).alias("cost")) for name in COST_REGIMES])
    return df.withColumn("_c", F.explode(regimes)).select(*df.columns, "_c.regime", "_c.cost")


def forward_labels(panel: DataFrame, cost: Column | None = None, thresholds: tuple[float, ...] = (0.003, 0.01, 0.03)) -> DataFrame:
    """Forward gross and net returns, whether the net one is a gain, and whether the gross one passes a threshold; null where the future is unknown."""
    cost = F.lit(round_trip_cost()) if cost is None else cost
    out = {}
    for (name, h), t in zip(HORIZONS.items(), thresholds, strict=True):
        gross = F.lead("close", h).over(ws()) / F.col("close") - 1
        out |= {
            f"gross_{name}": gross,
            f"net_{name}": gross - cost,
            f"target_{name}": F.when(gross.isNotNull(), (gross - cost > 0).cast("double")),
            f"above_{name}": F.when(gross.isNotNull(), (gross > t).cast("double")),
        }
    return panel.withColumns(out)


def liquidity_rank(panel: DataFrame, as_of: Column | None = None, last: int = 60, least: int = 20) -> DataFrame:
    """Symbols by the median turnover of their last bars up to ``as_of``."""
    panel = panel if as_of is None else panel.where(F.col("bar") <= as_of)
    recent = panel.withColumn("_k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("bar")))).where(F.col("_k") <= last)
    medians = recent.groupBy("symbol").agg(F.percentile(F.col("close") * F.col("volume"), 0.5).alias("turnover"), F.count("*").alias("bars"))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("turnover"), "symbol"))  # one row per symbol
    return medians.where((F.col("bars") >= least) & (F.col("turnover") > 0)).withColumn("rank", rank)


def regime_sma200(panel: DataFrame) -> DataFrame:
    mean = F.when(F.count("close").over(ws().rowsBetween(-199, 0)) >= 200, F.avg("close").over(ws().rowsBetween(-199, 0)))
    return panel.select("symbol", "bar", F.when(mean.isNull(), "UNKNOWN").when(F.col("close") > mean, "BULL").otherwise("BEAR").alias("regime"))


def market_regime(bench: DataFrame, vix: DataFrame, usual_vix: float = 14.5) -> DataFrame:
    """The market's state per bar from the benchmark's means, momentum and volatility and from a volatility index. One row per bar."""
    order = Window.partitionBy(F.lit(0)).orderBy("bar")

    def over(n: int):
        return order.rowsBetween(-(n - 1), 0)

    df = bench.join(vix, "bar", "left").withColumn("r", F.col("bclose") / F.lag("bclose").over(order) - 1)
    n = F.row_number().over(order)
    close = F.col("bclose")
    df = df.select(
        "bar",
        n.alias("n"),
        F.coalesce("value", F.lit(usual_vix)).alias("vix_level"),
        (close >= F.avg(close).over(over(20))).alias("above20"),
        (close >= F.avg(close).over(over(50))).alias("above50"),
        (close / F.lag(close, 20).over(order) - 1).alias("momentum"),
        (F.stddev_pop("r").over(over(20)) * YEAR).alias("vol"),
    )
    known = F.col("n") >= 50  # before that: a usual market
    vol = F.when(known, F.col("vol")).otherwise(0.14)
    above20, above50 = (F.when(known, F.col(c)).otherwise(True) for c in ("above20", "above50"))
    momentum = F.when(known, F.col("momentum")).otherwise(0.0)
    level = F.col("vix_level")
    regime = (
        F.when((level >= 22) | ((vol >= 0.30) & ~above50), "PANIC")
        .when(~above50 & ~above20 & (momentum < -0.03), "BEAR_TREND")
        .when(above50 & ((level >= 18) | (vol > 0.25)), "BULL_VOLATILE")
        .when(above50 & above20 & (level < 18), "BULL_TREND")
        .otherwise("SIDEWAYS")
    )
    df = df.select("bar", regime.alias("regime"), vol.alias("annual_vol"), "vix_level")
    of = F.create_map(*[F.lit(x) for pair in {"PANIC": 0.9, "BEAR_TREND": 0.85, "BULL_VOLATILE": 0.8, "BULL_TREND": 0.88, "SIDEWAYS": 0.75}.items() for x in pair])
    trend = F.when(F.col("regime").isin("PANIC", "BEAR_TREND"), "BEARISH").when(F.col("regime") == "SIDEWAYS", "NEUTRAL").otherwise("BULLISH")
    return df.withColumns({"confidence": of[F.col("regime")], "trend": trend})


def by_progress(panel: DataFrame, warm: int = 55, step: int = 3, tail: int = 21) -> DataFrame:
    """Every third bar from the warm-up to 21 before the end, with its partition by how far it is on."""
    n = F.count("*").over(Window.partitionBy("symbol"))
    df = panel.withColumns({"_i": F.row_number().over(ws()) - 1, "_n": n})
    progress = (F.col("_i") - warm) / F.nullif(F.col("_n") - tail - warm, F.lit(0))
    part = F.when(progress < 0.5, "TRAIN").when(progress < 0.75, "VALIDATION").when(progress < 0.9, "TEST").otherwise("HOLDOUT")
    picked = (F.col("_i") >= warm) & (F.col("_i") <= F.col("_n") - tail) & ((F.col("_i") - warm) % step == 0) & (F.col("_n") - tail - warm > 0)
    return df.where(picked).withColumn("partition", part).drop("_i", "_n")


def make_folds(panel: DataFrame, folds: int = 4, train: int = 24, val: int = 6, test: int = 6, holdout: int = 6) -> DataFrame:
    """Walk-forward folds from the panel's first and last bar: a few rows, made by aggregation."""
    ends = panel.agg(F.min("bar").alias("first"), F.max("bar").alias("last")).withColumn("holdout_start", F.add_months("last", -holdout))
    last_in = panel.join(F.broadcast(ends), F.col("bar") < F.col("holdout_start")).agg(F.max("bar").alias("wf_end"), F.max("first").alias("first"))
    steps = last_in.select("*", F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("fold"))
    steps = steps.withColumn("test_end", F.add_months("wf_end", (F.col("fold") - folds) * val))
    steps = steps.withColumn("test_start", F.add_months("test_end", -test)).withColumn("val_start", F.add_months("test_start", -val))
    return steps.select(
        "fold",
        F.greatest("first", F.add_months("val_start", -train)).alias("train_start"),
        F.col("val_start").alias("train_end"),
        "val_start",
        F.col("test_start").alias("val_end"),
        "test_start",
        "test_end",
    )


def assign_folds(panel: DataFrame, folds: DataFrame, purge: int = 0) -> DataFrame:
    """Rows by fold and role, half-open ranges; a row may stand in several folds. ``purge`` days before a border are left out of training."""
    ranges = folds.select(
        "fold",
        F.explode(
            F.array(
                F.struct(F.lit("TRAIN").alias("role"), F.col("train_start").alias("start"), F.date_sub("train_end", purge).alias("end")),
                F.struct(F.lit("VALIDATION").alias("role"), F.col("val_start").alias("start"), F.col("val_end").alias("end")),
                F.struct(F.lit("TEST").alias("role"), F.col("test_start").alias("start"), F.col("test_end").alias("end")),
            )
        ).alias("_r"),
    ).select("fold", "_r.*")
    # folds are a few rows by construction
    return panel.join(F.broadcast(ranges), (F.col("bar") >= F.col("start")) & (F.col("bar") < F.col("end"))).drop("start", "end")


def leaks(before: DataFrame, after: DataFrame, until: Column) -> DataFrame:
    """Rows up to ``until`` that differ between features computed before and after later rows were changed: none, if there's no leak."""
    a, b = before.where(F.col("bar") <= until), after.where(F.col("bar") <= until)
    return a.exceptAll(b).unionByName(b.exceptAll(a))
