"""Queries on bars: resampling, cleaning, features and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.columns import rounded
from barloom.operators import features
from barloom.plans.oracle import WINDOWS
from barloom.plans.oracle import rounded as r
from barloom.plans.oracle import sql
from barloom.sources import tables

OHLC = "open high low close volume"


def resample_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tables.bars(spark, sf_dir))


def feature_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = tables.bars(spark, sf_dir)
    return rounded(features.feature_panel(panel, tables.benchmark(panel)).withColumn("rn", F.col("rn").cast("long")))


def feature_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = tables.bars(spark, sf_dir)
    return rounded(features.extra_features(panel, tables.benchmark(panel)))


def feature_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.feature_grid(tables.bars(spark, sf_dir)))


GRID_SUMS = ", ".join(
    f"sum(greatest({s}b.delta, 0) * pow(1 - 1 / {n}.0, a.rn - b.rn)) AS {side}{n}" for n in (7, 14, 21) for s, side in (("", "gain"), ("-", "loss"))
) + ", " + ", ".join(f"sum(b.close * pow(1 - 2 / {n + 1}.0, a.rn - b.rn) * CASE WHEN b.rn = 0 THEN 1 ELSE 2 / {n + 1}.0 END) AS ema_{n}" for n in (9, 20, 50))

QUERIES = {
    "resample_bars": resample_bars,
    "feature_panel": feature_panel,
    "feature_extras": feature_extras,
    "feature_grid": feature_grid,
}

ORACLE_SQL = {
    "resample_bars": sql(f"SELECT symbol, bar::VARCHAR AS bar, {r(OHLC)} FROM bars"),
    "feature_panel": sql(f"SELECT symbol, bar::VARCHAR AS bar, {r(OHLC)}, rn, {r(' '.join(features.DEFAULTS))} FROM panel"),
    "feature_extras": sql(
        f"""SELECT symbol, bar::VARCHAR AS bar, {r('close rsi_14_wilder macd_line macd_signal macd_hist_raw stoch_d momentum_10 atr_14 ann_vol_pop downside_pop '
        'max_drawdown_20d max_drawdown_60d gap_risk tail_risk_5pct volume_stability liquidity_score close_zscore close_percentile bb_middle')},
        CASE WHEN rsi_14_wilder > 70 THEN 'OVERBOUGHT' WHEN rsi_14_wilder < 30 THEN 'OVERSOLD' WHEN rsi_14_wilder IS NOT NULL THEN 'NEUTRAL' END AS rsi_stance,
        CASE WHEN macd_line >= macd_signal THEN 'BULLISH' ELSE 'BEARISH' END AS macd_trend, golden_cross,
        round(coalesce(beta, greatest(0.4, least(2.5, coalesce(ann_vol_pop / 0.15, 2.5)))), 2) AS beta_pop,
        round(bb_middle + 2 * sd20, 6) AS bb_upper, round(bb_middle - 2 * sd20, 6) AS bb_lower FROM extra""",
    ),
    "feature_grid": sql(
        "SELECT symbol, bar::VARCHAR AS bar, "
        + ", ".join(f"round(close / lag(close, {n}) OVER ws - 1, 6) + 0.0 AS ret_{n}" for n in (1, 3, 5, 10, 20, 60, 100, 200))
        + ", "
        + ", ".join(f"round(CASE WHEN rn >= {n - 1} THEN close / avg(close) OVER w{n} END, 6) AS price_sma_{n}" for n in (20, 50, 100, 200))
        + ", "
        + r("ema_9 ema_20 ema_50")
        + ", "
        + ", ".join(f"round(CASE WHEN rn >= {n} THEN 100 - 100 / (1 + gain{n} / nullif(loss{n}, 0)) END, 6) AS rsi_{n}" for n in (7, 14, 21))
        + f", round(CASE WHEN rn >= 99 THEN close / max(close) OVER w252 - 1 END, 6) + 0.0 AS dist_high, round(CASE WHEN rn >= 99 THEN close / min(close) OVER w252 - 1 END, 6) + 0.0 AS dist_low FROM moves JOIN grid USING (symbol, rn) {WINDOWS}",
        grid=f"SELECT a.symbol, a.rn, {GRID_SUMS} FROM moves a JOIN moves b ON a.symbol = b.symbol AND b.rn <= a.rn GROUP BY a.symbol, a.rn",
    ),
}
