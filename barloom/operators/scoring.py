"""Scores, expected returns, risk, decisions and explanations: row expressions over features.

Formulas are levels of SQL expressions, so that one definition serves batches, streams and checks. Fixed values follow their published tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import layered

HORIZONS = {"1d": (1, 0.60), "5d": (5, 1.0), "20d": (20, 1.35)}

#: Each factor's weight and how it is normalised.
FACTORS = {
    "momentum_5": (0.18, "momentum_5 / 0.05"),
    "momentum_20": (0.12, "momentum_20 / 0.05"),
    "sma_50_dist": (0.16, "sma_50_dist / 0.06"),
    "rsi_14": (0.12, "(rsi_14 - 50) / 25"),
    "macd_hist": (0.14, "macd_hist / 0.02"),
    "volume_z_score": (0.08, "volume_z_score / 2.0"),
    "relative_strength_nifty": (0.12, "relative_strength_nifty / 0.04"),
    "news_sentiment": (0.08, "news_sentiment"),
}


def probability(x: str) -> str:
    return f"round(greatest(0.05, least(0.95, 1 / (1 + exp(-({x}))))), 4)"


_PARTS = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE greatest(-2.5, least(2.5, {e})) * {w} END" for c, (w, e) in FACTORS.items())
_WEIGHT = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {w} END" for c, (w, _) in FACTORS.items())

SCORES = [
    {"raw_score": f"coalesce(({_PARTS}) / nullif(CAST({_WEIGHT} AS DOUBLE), 0), 0)"},
    {f"prob_{h}": probability(f"raw_score * {scale}") for h, (_, scale) in HORIZONS.items()}
    | {f"fallback_{h}": probability(f"((50 - rsi_14) * 0.02 + momentum_5 * 2.0 + sma_50_dist * 1.5) * {scale}") for h, (_, scale) in HORIZONS.items()},
    {
        "signal_quality": "CASE WHEN prob_20d >= 0.65 OR prob_20d <= 0.35 THEN 'HIGH' WHEN prob_20d >= 0.58 OR prob_20d <= 0.42 THEN 'MEDIUM' ELSE 'LOW' END",
        "data_quality": "CASE WHEN rn + 1 >= 50 THEN 'HIGH' WHEN rn + 1 >= 20 THEN 'MEDIUM' ELSE 'LOW' END",
        "quality_score": "greatest(CAST(0.1 AS DOUBLE), 1.0 - CASE WHEN rsi_14 IS NULL THEN 0.25 ELSE 0 END - CASE WHEN macd_hist IS NULL THEN 0.20 ELSE 0 END"
        " - CASE WHEN sma_50_dist IS NULL THEN 0.25 ELSE 0 END - CASE WHEN atr_14 IS NULL THEN 0.15 ELSE 0 END)",
        "downside": "round(greatest(0.05, least(0.95, 1 - prob_20d)), 4)",
    },
]

#: Zero counts as missing in these inputs.
RISK = [
    {"atr": "coalesce(nullif(atr_14, 0), close * 0.02)"},
    {
        "stop_loss": "round(greatest(0.01, close - 2.0 * atr), 2)",
        "target": "round(close + 3.0 * atr, 2)",
        "vol_a": "coalesce(nullif(annualized_volatility, 0), atr / close * sqrt(252))",
        "tail": "abs(coalesce(nullif(tail_risk_5pct, 0), -0.03))",
        "drawdown": "coalesce(nullif(max_drawdown_60d, 0), 0.05)",
        "beta": "coalesce(nullif(beta_nifty, 0), 1.0)",
        "atr_p": "coalesce(nullif(atr_percent, 0), atr / close)",
        "gap": "coalesce(nullif(gap_risk, 0), 0.005)",
        "turnover": "coalesce(nullif(liquidity_score, 0), 6.0)",
    },
    {
        "reward_risk": "round(greatest(0.01, target - close) / greatest(0.01, close - stop_loss), 2)",
        "down_dev": "coalesce(nullif(downside_deviation, 0), vol_a * 0.7)",
        "illiquid": "CASE WHEN volume < 50000 * {lots} OR turnover < 6.4 THEN 1 ELSE 0 END",
    },
    {
        "risk_raw": "0.18 * least(1.0, vol_a / 0.50) + 0.18 * least(1.0, down_dev / 0.35) + 0.15 * least(1.0, drawdown / 0.25)"
        " + 0.12 * least(1.0, greatest(0, (beta - 0.5) / 1.5)) + 0.12 * least(1.0, atr_p / 0.05) + 0.08 * least(1.0, gap / 0.02)"
        " + 0.10 * least(1.0, tail / 0.08) + 0.07 * CASE WHEN illiquid = 1 THEN 1.0 ELSE greatest(0, (8.5 - turnover) / 3.0) END",
    },
    {"risk_score": "CAST(round(least(100, greatest(0, risk_raw * 60 + downside * 40)), 0) AS BIGINT)"},
    {
        "risk_state": "CASE WHEN tail > 0.08 OR close <= stop_loss THEN 'EMERGENCY' WHEN risk_score >= 85 THEN 'EXIT' WHEN risk_score >= 65 THEN 'HIGH_RISK'"
        " WHEN risk_score >= 45 THEN 'CAUTION' ELSE 'NORMAL' END",
        "kelly": "greatest(0, ((1 - downside) * greatest(1.0, reward_risk) - downside) / greatest(1.0, reward_risk))",
    },
    {"weight": "round(least(0.15, greatest(0.02, kelly * 0.25 * CASE WHEN illiquid = 1 THEN 0.5 ELSE 1.0 END)), 4)"},
]

DECISION = [
    {
        "decision": "CASE WHEN data_quality = 'LOW' OR illiquid = 1 OR signal_quality = 'LOW' THEN 'NO_TRADE'"
        " WHEN downside >= CASE WHEN regime = 'PANIC' THEN 0.65 ELSE 0.75 END OR prob_20d <= 0.26 THEN 'STRONG_SELL'"
        " WHEN downside >= CASE WHEN regime = 'PANIC' THEN 0.50 WHEN regime IN ('BEAR', 'BEAR_TREND') THEN 0.55 ELSE 0.60 END OR prob_20d <= 0.38 THEN 'SELL'"
        " WHEN downside >= 0.50 OR prob_20d <= 0.46 THEN 'REDUCE'"
        " WHEN regime = 'PANIC' THEN CASE WHEN prob_20d >= 0.75 AND reward_risk >= 2.5 THEN 'ACCUMULATE' ELSE 'HOLD' END"
        " WHEN prob_20d >= CASE WHEN regime IN ('BEAR', 'BEAR_TREND') THEN 0.80 ELSE 0.75 END AND reward_risk >= {strong_hurdle} THEN 'STRONG_BUY'"
        " WHEN prob_20d >= CASE WHEN regime IN ('BEAR', 'BEAR_TREND') THEN 0.68 ELSE 0.62 END AND reward_risk >= {hurdle} THEN 'BUY'"
        " WHEN prob_20d >= 0.54 AND regime NOT IN ('BEAR', 'BEAR_TREND') THEN 'ACCUMULATE' ELSE 'HOLD' END"
    }
]

#: 85th, 50th and 15th percentile returns over 20 bars, where none are fitted.
SCENARIOS = [
    {
        "vol_scale": "greatest(0.35, least(3.5, atr_percent / 0.020))",
        "p_bull": "greatest(0.10, least(0.45, prob_20d * 0.45))",
        "p_bear": "greatest(0.10, least(0.45, downside * 0.45))",
    },
    {
        "bull_return": "round(round(0.038 * vol_scale, 4) * 100, 2)",
        "base_return": "round(round(0.010 * vol_scale, 4) * 100, 2)",
        "bear_return": "round(round(-0.024 * vol_scale, 4) * 100, 2)",
        "p_sum": "p_bull + p_bear + greatest(0.10, 1 - p_bull - p_bear)",
    },
    {"bull_prob": "CAST(round(CAST(p_bull / p_sum AS DECIMAL(20, 8)), 4) AS DOUBLE)", "bear_prob": "CAST(round(CAST(p_bear / p_sum AS DECIMAL(20, 8)), 4) AS DOUBLE)"},
    {
        "base_prob": "round(1.0 - bull_prob - bear_prob, 4)",
        "bull_price": "close * (1 + bull_return / 100)",
        "base_price": "close * (1 + base_return / 100)",
        "bear_price": "close * (1 + bear_return / 100)",
        "support": "CASE WHEN sma_50_dist <> 0 THEN close / (1 + sma_50_dist) ELSE close * 0.97 END",
    },
]

CATALYST = [
    {
        "direction": "CASE WHEN ret_1d * 100 > 0.2 THEN 'UP' WHEN ret_1d * 100 < -0.2 THEN 'DOWN' ELSE 'FLAT' END",
        "surge": "round(volume / greatest(1, avg_volume), 2)",
    },
    {
        "catalyst": "CASE WHEN surge >= 1.6 AND abs(ret_1d) * 100 >= 1.5 THEN 'VOLUME_SPIKE' WHEN ret_1d * 100 >= 2.0 THEN 'MOMENTUM_BREAKOUT'"
        " WHEN ret_1d * 100 <= -2.0 THEN 'PROFIT_BOOKING' WHEN ret_1d >= 0 THEN 'TECHNICAL_BREAKOUT' ELSE 'RANGE_ACCUMULATION' END",
        "confidence": "CAST(greatest(60, round(greatest(prob_20d, 1 - prob_20d, 0.65) * 100, 0)) AS BIGINT)",
        "legacy_confidence": "CAST(least(94, greatest(68, round(76 + ret_1d * 100 * 3.5 + CASE WHEN volume > 1000000 THEN 5 ELSE 0 END, 0))) AS BIGINT)",
    },
]


def filled(layers: list[dict[str, str]], **values: float) -> list[dict[str, str]]:
    """Levels with their parameters put in."""
    out = []
    for layer in layers:
        new = {}
        for c, e in layer.items():
            for k, v in values.items():
                e = e.replace("{" + k + "}", str(v))
            new[c] = e
        out.append(new)
    return out


def score(state: DataFrame) -> DataFrame:
    """``state`` (features of each bar) with heuristic and fallback probabilities and quality marks."""
    return layered(state, SCORES)


def risk(scored: DataFrame, lots: float = 1.0) -> DataFrame:
    """Stops, targets, composite risk, state and a quarter-Kelly weight. ``lots`` scales the least volume."""
    return layered(scored, filled(RISK, lots=lots))


def decide(rated: DataFrame, hurdle: float = 1.8, strong_hurdle: float = 2.4) -> DataFrame:
    """The decision by probability, downside, reward to risk and regime (a column of ``rated``)."""
    return layered(rated, filled(DECISION, hurdle=hurdle, strong_hurdle=strong_hurdle))


def contributions(scored: DataFrame) -> DataFrame:
    """What each factor adds, largest first: one row per factor."""
    of = {c: "(rsi_14 - 50) * 0.005" if c == "rsi_14" else f"{c} * 0.12" if c == "news_sentiment" else f"{c} * 1.2" for c in FACTORS}
    parts = F.array(*[F.struct(F.lit(c).alias("factor"), F.expr(f"round(greatest(-0.25, least(0.25, coalesce({e}, 0))), 3)").cast("double").alias("contribution")) for c, e in of.items()])
    ordered = F.array_sort(parts, lambda a, b: F.when(F.abs(a["contribution"]) > F.abs(b["contribution"]), -1).when(F.abs(a["contribution"]) < F.abs(b["contribution"]), 1).when(a["factor"] < b["factor"], -1).when(a["factor"] > b["factor"], 1).otherwise(0))
    return scored.select("symbol", "bar", F.posexplode(ordered).alias("place", "c")).select("symbol", "bar", "place", "c.*")


def tenths(x: Column) -> Column:
    """One decimal, as text."""
    return F.round(x, 1).cast("decimal(20,1)").cast("string")


def evidence(scored: DataFrame, news: DataFrame | None = None) -> DataFrame:
    """Texts that speak for a score, each with its kind and weight. ``news`` holds a row per symbol (symbol, headline, score, severity, event)."""
    if news is None:
        scored = scored.withColumn("news", F.lit(None).cast("struct<headline: string, score: bigint, severity: string, event: string>"))
    else:
        scored = scored.join(news.select("symbol", F.struct("headline", "score", "severity", "event").alias("news")), "symbol", "left")
    plus = F.when(F.col("news.score") > 0, "+").otherwise("")
    told = F.concat(F.lit("["), F.col("news.event"), F.lit("] "), F.col("news.headline"), F.lit(" (sentiment "), plus, F.col("news.score").cast("string"), F.lit(", severity "), F.col("news.severity"), F.lit(")"))
    z = F.col("volume_z_score")
    dist = F.col("sma_50_dist") * 100
    stance = F.when(F.col("rsi_14") > 70, "overbought").when(F.col("rsi_14") < 30, "oversold").otherwise("balanced")
    signed = F.when(dist >= 0, "+").otherwise("")
    items = [
        F.when(F.col("news.headline").isNotNull(), F.struct(F.lit("NEWS").alias("kind"), told.alias("text"), F.lit(0.30).alias("weight"))),
        F.struct(F.lit("TECHNICAL").alias("kind"), F.concat(F.lit("RSI(14) at "), tenths(F.col("rsi_14")), F.lit(", "), stance).alias("text"), F.lit(0.25).alias("weight")),
        F.struct(F.lit("TREND").alias("kind"), F.concat(signed, tenths(dist), F.lit("% from the 50-bar mean")).alias("text"), F.lit(0.20).alias("weight")),
        F.when(F.abs("volume_z_score") > 1, F.struct(F.lit("LIQUIDITY").alias("kind"), F.concat(F.lit("volume z-score "), F.when(z >= 0, "+").otherwise(""), tenths(z), F.lit(", "), F.when(z > 1.5, "far above usual").otherwise("unusual")).alias("text"), F.lit(0.15).alias("weight"))),
        F.struct(F.lit("REGIME").alias("kind"), F.concat(F.lit("regime "), F.col("regime")).alias("text"), F.lit(0.10).alias("weight")),
    ]
    return scored.select("symbol", "bar", F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("e")).select("symbol", "bar", "e.*")


def expected_return(bucketed: DataFrame, prob: str, vol: str, days: int) -> DataFrame:
    """Expected value, interval and method from the bucket that :func:`barloom.operators.joins.lookup_buckets` found, else from diffusion."""
    layers = [
        {"_p": f"greatest(0.01, least(0.99, {prob}))", "market_vol": f"round({vol} * sqrt({days}), 4)", "_s": f"greatest(0.35, least(3.5, {vol} / 0.020))"},
        {
            side: f"CAST(round(CAST(coalesce(bucket.{side} * _s, 0.85 * market_vol) AS DECIMAL(20, 8)), 4) AS DOUBLE)"  # in decimals: halves are common here
            for side in ("gain", "loss")
        },
        {"_ev": "_p * gain - (1 - _p) * loss"},
        {
            "expected_value": "round(_ev, 4)",
            "ci_low": "round(_ev - 1.96 * market_vol, 4)",
            "ci_high": "round(_ev + 1.96 * market_vol, 4)",
            "uncertainty": "coalesce(bucket.uncertainty, round(market_vol / sqrt(20), 4))",
            "samples": "coalesce(bucket.n, 0)",
            "method": "coalesce(bucket.kind, 'DIFFUSION')",
        },
    ]
    return layered(bucketed, layers).drop("_p", "_s", "_ev", "bucket")
