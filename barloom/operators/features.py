"""Point-in-time features of each bar: only rows up to the bar are used.

All windows share the clustering by symbol, so the plan has one exchange of bars by symbol (exponential means add one row per chunk).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import clamp, finite, ratio
from barloom.operators.recurrence import ema, numbered, weighted_sums, wilder

YEAR = math.sqrt(252)

#: The 25 model inputs and the value that stands for an unknown one.
DEFAULTS = {
    "rsi_14": 50.0, "macd_hist": 0.0, "stoch_k": 50.0, "roc_12": 0.0, "sma_20_dist": 0.0, "sma_50_dist": 0.0, "ema_20_dist": 0.0,
    "atr_percent": 0.02, "bb_width": 0.05, "vol_20d": 0.20, "vol_60d": 0.20, "annualized_volatility": 0.20, "downside_deviation": 0.15,
    "ret_1d": 0.0, "ret_5d": 0.0, "ret_20d": 0.0, "momentum_5": 0.0, "momentum_20": 0.0, "gap_pct": 0.0, "dist_52w_high": 0.0,
    "dist_52w_low": 0.0, "volume_z_score": 0.0, "rel_volume": 1.0, "beta_nifty": 1.0, "relative_strength_nifty": 0.0,
}


def ws():
    return Window.partitionBy("symbol").orderBy("bar")


def w(n: int):
    return ws().rowsBetween(-(n - 1), 0)


def full(n: int, x: Column | str, e: Column, least: int | None = None) -> Column:
    """``e`` where the last n rows hold ``least`` (or n) values of x."""
    return F.when(F.count(x).over(w(n)) >= (least or n), e)


def change(x: str, n: int) -> Column:
    return ratio(F.col(x), F.lag(x, n).over(ws())) - 1


def align_benchmark(panel: DataFrame, bench: DataFrame) -> DataFrame:
    """As-of join along the symbol's own bars: the benchmark's value of the bar, else the last one before it."""
    joined = panel.join(bench, "bar", "left")
    return joined.withColumn("bclose", F.last("bclose", ignorenulls=True).over(ws().rowsBetween(Window.unboundedPreceding, 0)))


def true_range() -> Column:
    before = F.lag("close").over(ws())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def measured(panel: DataFrame, bench: DataFrame) -> DataFrame:
    """``panel`` (bars) with the recurrences and changes that the inputs and their variants are made of. What isn't used is pruned."""
    df = numbered(align_benchmark(panel, bench))
    before = F.lag("close").over(ws())
    delta = F.col("close") - before
    df = df.withColumns(
        {
            "_gain": F.greatest(delta, F.lit(0.0)) + F.lit(0.0) * delta,
            "_loss": F.greatest(-delta, F.lit(0.0)) + F.lit(0.0) * delta,
            "_r": change("close", 1),
            "_rb": change("bclose", 1),
            "_tr": true_range(),
            "_gap": F.abs(ratio(F.col("open") - before, before)),
        }
    )
    df = weighted_sums(df, {"_sg": ("_gain", 13 / 14), "_sl": ("_loss", 13 / 14)})
    df = wilder(df, {"_ag": "_gain", "_al": "_loss", "_atr": "_tr"}, 14)
    df = ema(df, {"_e12": ("close", 2 / 13), "_e26": ("close", 2 / 27), "_e20": ("close", 2 / 21)})
    df = ema(df.withColumn("_macd", F.col("_e12") - F.col("_e26")), {"_signal": ("_macd", 0.2)})
    df = sliding_drawdowns(df, "close", {"_fall20": 20, "_fall60": 60})
    low14, high14 = (full(14, c, f(c).over(w(14))) for c, f in (("low", F.min), ("high", F.max)))
    return df.withColumn("_k14", ratio(100 * (F.col("close") - low14), high14 - low14))


KEPT = ["symbol", "bar", "open", "high", "low", "close", "volume", "rn"]


def feature_panel(panel: DataFrame, bench: DataFrame) -> DataFrame:
    """``panel`` (bars) with the 25 model inputs; unknown values get their defaults, infinite ones 0."""
    return measured(panel, bench).select(*KEPT, *[e.alias(c) for c, e in inputs().items()])


def extra_features(panel: DataFrame, bench: DataFrame) -> DataFrame:
    """Further inputs and variants: population deviations, Wilder's smoothing, drawdowns, tails, bands, liquidity and crosses."""
    return measured(panel, bench).select("symbol", "bar", "close", *[e.alias(c) for c, e in extras().items()])


def all_features(panel: DataFrame, bench: DataFrame, wanted: list[str]) -> DataFrame:
    """The inputs and the ``wanted`` extras from one pass over the bars."""
    more = extras()
    return measured(panel, bench).select(*KEPT, *[e.alias(c) for c, e in inputs().items()], *[more[c].alias(c) for c in wanted])


def inputs() -> dict[str, Column]:
    """The 25 model inputs over the columns of :func:`measured`."""
    close, volume = F.col("close"), F.col("volume")
    sma20, sma50 = full(20, "close", F.avg("close").over(w(20))), full(50, "close", F.avg("close").over(w(50)))
    vol20 = full(20, "_r", F.stddev_samp("_r").over(w(20)) * YEAR)
    v_mean, v_std = full(20, "volume", F.avg("volume").over(w(20))), full(20, "volume", F.stddev_samp("volume").over(w(20)))
    both = F.when(F.col("_r").isNotNull() & F.col("_rb").isNotNull(), 1)
    beta = full(60, both, ratio(F.covar_samp("_r", "_rb").over(w(60)), F.var_samp("_rb").over(w(60))))
    low_r = F.least(F.col("_r"), F.lit(0.0)) + F.lit(0.0) * F.col("_r")
    ret = {n: change("close", n) for n in (1, 5, 12, 20)}
    top, bottom = full(252, "high", F.max("high").over(w(252)), 40), full(252, "low", F.min("low").over(w(252)), 40)
    values = {
        "rsi_14": F.when(F.col("rn") >= 14, 100 - 100 / (1 + ratio(F.col("_sg"), F.col("_sl")))),
        "macd_hist": ratio(F.col("_macd") - F.col("_signal"), close),
        "stoch_k": F.col("_k14"),
        "roc_12": ret[12] * 100,
        "sma_20_dist": ratio(close - sma20, sma20),
        "sma_50_dist": ratio(close - sma50, sma50),
        "ema_20_dist": ratio(close - F.col("_e20"), F.col("_e20")),
        "atr_percent": ratio(full(14, "_tr", F.avg("_tr").over(w(14))), close),
        "bb_width": ratio(4 * full(20, "close", F.stddev_samp("close").over(w(20))), sma20),
        "vol_20d": vol20,
        "vol_60d": full(60, "_r", F.stddev_samp("_r").over(w(60)) * YEAR),
        "annualized_volatility": vol20,
        "downside_deviation": full(20, "_r", F.stddev_samp(low_r).over(w(20)) * YEAR),
        "ret_1d": ret[1],
        "ret_5d": ret[5],
        "ret_20d": ret[20],
        "momentum_5": ret[5],
        "momentum_20": ret[20],
        "gap_pct": ratio(F.col("open") - F.lag("close").over(ws()), F.lag("close").over(ws())),
        "dist_52w_high": ratio(close - top, top),
        "dist_52w_low": ratio(close - bottom, bottom),
        "volume_z_score": clamp(ratio(volume - v_mean, v_std), -3, 3) + F.lit(0.0) * ratio(volume - v_mean, v_std),
        "rel_volume": clamp(ratio(volume, v_mean), 0.1, 10) + F.lit(0.0) * ratio(volume, v_mean),
        "beta_nifty": clamp(beta, 0.2, 3) + F.lit(0.0) * beta,
        "relative_strength_nifty": ret[20] - change("bclose", 20),
    }
    return {c: F.coalesce(finite(e), F.lit(DEFAULTS[c])) for c, e in values.items()}


def warm(features: DataFrame, least: int = 50) -> DataFrame:
    """Only bars that have ``least`` bars of their symbol up to them: before that there are no features."""
    return features.where(F.col("rn") + 1 >= least)


def sliding_drawdowns(df: DataFrame, x: str, sizes: dict[str, int]) -> DataFrame:
    """``df`` (with ``rn``) and the deepest fall from a peak within the last n rows, as a positive share, for each name's n.

    A symbol's rows are cut into blocks of n. The last n rows are the end of one block and the beginning of the next, so running values from a block's first row
    and to its last one are enough: (highest, lowest, fall) of two parts give those of both. No row holds its window.
    """
    for name, n in sizes.items():
        block = Window.partitionBy("symbol", F.floor(F.col("rn") / n)).orderBy("rn")
        begun, left = block.rowsBetween(Window.unboundedPreceding, 0), block.rowsBetween(0, Window.unboundedFollowing)
        value = F.col(x)
        df = df.withColumns({"_high": F.max(x).over(begun), "_low": F.min(x).over(begun), "_top": F.max(x).over(left), "_bottom": F.min(x).over(left)})
        fall, rest = F.max(ratio(F.col("_high") - value, F.col("_high"))).over(begun), F.max(ratio(value - F.col("_bottom"), value)).over(left)
        df = df.withColumns({"_fall": fall, "_rest": rest})
        top, before = F.lag("_top", n - 1).over(ws()), F.lag("_rest", n - 1).over(ws())
        one_block = (F.col("rn") < n - 1) | (F.col("rn") % n == n - 1)
        both = F.greatest(F.col("_fall"), before, ratio(top - F.col("_low"), top))
        df = df.withColumn(name, F.coalesce(F.when(one_block, F.col("_fall")).otherwise(both), F.lit(0.0))).drop("_high", "_low", "_top", "_bottom", "_fall", "_rest")
    return df


def extras() -> dict[str, Column]:
    """The variants over the columns of :func:`measured`."""
    close, line = F.col("close"), F.col("_macd")
    returns = F.sort_array(F.filter(F.collect_list("_r").over(w(60)), lambda x: x.isNotNull()))
    n60 = F.size(returns)
    tail = F.when(n60 >= 20, F.get(returns, F.floor(n60 * 0.05).cast("int"))).otherwise(-0.03)
    v_mean = F.avg("volume").over(w(20))
    sma50 = full(50, "close", F.avg("close").over(w(50)))
    sma200 = F.when(F.col("rn") >= 149, F.avg("close").over(w(200)))
    sma20, sd20 = full(20, "close", F.avg("close").over(w(20))), F.stddev_pop("close").over(w(20))
    rsi = 100 - 100 / (1 + ratio(F.col("_ag"), F.col("_al")))
    rsi = F.when(F.col("rn") >= 14, F.when(F.col("_al") == 0, 100.0).otherwise(rsi))
    vol = full(20, "_r", F.stddev_pop("_r").over(w(20)) * YEAR, 10)
    pairs = F.count(F.when(F.col("_r").isNotNull() & F.col("_rb").isNotNull(), 1)).over(w(60))
    beta = F.when(pairs >= 20, ratio(F.covar_pop("_r", "_rb").over(w(60)), F.var_pop("_rb").over(w(60))))
    closes = F.collect_list("close")
    return {
        "rsi_14_wilder": rsi,
        "rsi_stance": F.when(rsi > 70, "OVERBOUGHT").when(rsi < 30, "OVERSOLD").when(rsi.isNotNull(), "NEUTRAL"),
        "macd_line": line,
        "macd_signal": F.col("_signal"),
        "macd_hist_raw": line - F.col("_signal"),
        "macd_trend": F.when(line >= F.col("_signal"), "BULLISH").otherwise("BEARISH"),
        "stoch_d": full(3, "_k14", F.avg("_k14").over(w(3))),
        "momentum_10": change("close", 10),
        "atr_14": F.col("_atr"),
        "ann_vol_pop": vol,
        "downside_pop": full(20, "_r", F.sqrt(F.avg(F.pow(F.least(F.col("_r"), F.lit(0.0)) + F.lit(0.0) * F.col("_r"), 2)).over(w(20))) * YEAR, 10),
        "max_drawdown_20d": F.col("_fall20"),
        "max_drawdown_60d": F.col("_fall60"),
        "gap_risk": F.coalesce(F.avg("_gap").over(w(20)), F.lit(0.005)),
        "tail_risk_5pct": tail,
        "volume_stability": ratio(F.stddev_pop("volume").over(w(20)), v_mean),
        "liquidity_score": F.log10(F.greatest(F.lit(1.0), close * v_mean)),
        "beta_pop": F.round(F.coalesce(beta, clamp(vol / 0.15, 0.4, 2.5)), 2),
        "close_zscore": full(5, "close", ratio(close - F.avg("close").over(w(20)), sd20), 5),
        "close_percentile": (F.size(F.filter(closes.over(w(60)), lambda x: x < close)) / F.count("close").over(w(60)) * 100),
        "golden_cross": F.when(sma50 >= sma200, "GOLDEN").when(sma50 < sma200, "DEATH"),
        "bb_upper": (sma20 + 2 * sd20),
        "bb_middle": sma20,
        "bb_lower": (sma20 - 2 * sd20),
    }


def feature_grid(panel: DataFrame, returns=(1, 3, 5, 10, 20, 60, 100, 200), means=(20, 50, 100, 200), emas=(9, 20, 50), rsis=(7, 14, 21)) -> DataFrame:
    """A parametrised family of returns, distances to means and extremes, and oscillators."""
    df = numbered(panel)
    delta = F.col("close") - F.lag("close").over(ws())
    df = df.withColumns({"_gain": F.greatest(delta, F.lit(0.0)), "_loss": F.greatest(-delta, F.lit(0.0))})
    df = weighted_sums(df, {f"_{side}{n}": (f"_{side}", 1 - 1 / n) for n in rsis for side in ("gain", "loss")})
    df = ema(df, {f"ema_{n}": ("close", 2 / (n + 1)) for n in emas})
    close = F.col("close")
    top, bottom = full(252, "close", F.max("close").over(w(252)), 100), full(252, "close", F.min("close").over(w(252)), 100)
    return df.select(
        "symbol",
        "bar",
        *[change("close", n).alias(f"ret_{n}") for n in returns],
        *[ratio(close, full(n, "close", F.avg("close").over(w(n)))).alias(f"price_sma_{n}") for n in means],
        *[F.col(f"ema_{n}") for n in emas],
        *[F.when(F.col("rn") >= n, 100 - 100 / (1 + ratio(F.col(f"_gain{n}"), F.col(f"_loss{n}")))).alias(f"rsi_{n}") for n in rsis],
        (ratio(close, top) - 1).alias("dist_high"),
        (ratio(close, bottom) - 1).alias("dist_low"),
    )
