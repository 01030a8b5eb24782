"""Queries on scores, risk, decisions and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import layered, rounded
from barloom.operators import features, labels, news, scoring
from barloom.operators.features import w
from barloom.operators.joins import latest, top
from barloom.plans.oracle import layered as nested
from barloom.plans.oracle import rounded as r
from barloom.plans.oracle import sql
from barloom.plans.data_queries import NAMED, REGIME, named
from barloom.plans.news_sql import NEWS, TOLD
from barloom.sources import tables

#: Volumes here are far below shares traded on an exchange, so the least volume is scaled.
LOTS = 0.0001


def state(spark, sf_dir) -> DataFrame:
    """Features and further inputs of each bar, in one pass over the bars, with the market's regime (one row per bar)."""
    panel = tables.bars(spark, sf_dir)
    bench = tables.benchmark(panel)
    df = features.all_features(panel, bench, ["atr_14", "max_drawdown_60d", "gap_risk", "tail_risk_5pct", "liquidity_score"])
    regime = labels.market_regime(bench, tables.vix(bench)).select("bar", "regime")
    return df.join(regime, "bar").withColumn("news_sentiment", F.lit(None).cast("double"))


def rated(spark, sf_dir) -> DataFrame:
    return scoring.decide(scoring.risk(scoring.score(state(spark, sf_dir)), LOTS), 1.4, 1.5)


RATED_LAYERS = scoring.SCORES + scoring.filled(scoring.RISK, lots=LOTS) + scoring.filled(scoring.DECISION, hurdle=1.4, strong_hurdle=1.5)
LOCAL = {"regime_of": REGIME, "full_state": "SELECT state.*, regime FROM state JOIN regime_of USING (bar)", "rated": nested("full_state", RATED_LAYERS)}
SCORED = "raw_score prob_1d prob_5d prob_20d fallback_1d fallback_5d fallback_20d quality_score downside"
RISKS = "stop_loss target reward_risk risk_raw kelly weight"


def scored_signals(spark, sf_dir):
    return rounded(scoring.score(state(spark, sf_dir)).select("symbol", "bar", "signal_quality", "data_quality", *SCORED.split()))


def risk_levels(spark, sf_dir):
    return rounded(rated(spark, sf_dir).select("symbol", "bar", "risk_score", "risk_state", "illiquid", *RISKS.split()))


def decisions(spark, sf_dir):
    return rounded(rated(spark, sf_dir).select("symbol", "bar", "regime", "decision"))


def scenarios(spark, sf_dir):
    shown = "bull_return base_return bear_return bull_prob base_prob bear_prob bull_price base_price bear_price support".split()
    return rounded(layered(scoring.score(state(spark, sf_dir)), scoring.SCENARIOS).select("symbol", "bar", *shown))


def feature_contributions(spark, sf_dir):
    return rounded(scoring.contributions(scoring.score(state(spark, sf_dir)))).withColumn("place", F.col("place").cast("long"))


def evidence(spark, sf_dir):
    told = news.symbol_sentiment(news.classify(tables.headlines(spark, sf_dir)), named(tables.universe(spark, sf_dir)))
    return rounded(scoring.evidence(state(spark, sf_dir), told))


def movement_catalyst(spark, sf_dir):
    df = scoring.score(state(spark, sf_dir)).withColumn("avg_volume", F.avg("volume").over(w(20)))
    return rounded(layered(df, scoring.CATALYST).select("symbol", "bar", "direction", "surge", "catalyst", "confidence", "legacy_confidence"))


def near(e: str, digits: int) -> str:
    """Rounded by way of a decimal: halves, which are common here, go the same way wherever this is computed."""
    return f"CAST(round(CAST({e} AS DECIMAL(24, 10)), {digits}) AS DOUBLE)"


#: Gains and losses of a five-bar position as the fallback distribution gives them.
RANKING = [
    {"vol5": near("atr_percent * sqrt(5)", 4)},
    {"gain5": near("0.85 * vol5", 4)},
    {"ev": "prob_5d * gain5 - downside * gain5", "dev": "greatest(0.01, coalesce(nullif(downside_deviation, 0), atr_p * 0.7))"},
    {
        "low_risk": near(
            "0.30 * least(1.0, greatest(0, (ev + 0.02) / 0.05)) + 0.30 * least(1.0, greatest(0, (ev / dev + 0.5) / 2.5))"
            " + 0.25 * (1 - risk_score / 100.0) + 0.15 * CASE WHEN illiquid = 1 THEN 0.3 ELSE 1.0 END",
            4,
        ),
        "high_alpha": near(
            "0.30 * least(1.0, greatest(0, (ev + 0.01) / 0.08)) + 0.25 * least(1.0, greatest(0, reward_risk / 4.0)) + 0.20 * (CAST(1 AS DOUBLE) / 3)"
            " + 0.10 * CASE WHEN beta >= 1.1 THEN 1.0 ELSE 0.6 END - CASE WHEN vol_a > 0.45 THEN (vol_a - 0.45) * 1.5 ELSE 0 END"
            " - CASE WHEN drawdown > 0.15 THEN (drawdown - 0.15) * 1.2 ELSE 0 END",
            4,
        ),
        "sells": "CASE WHEN decision IN ('SELL', 'STRONG_SELL') THEN 1 ELSE 0 END",
        "conviction": "CAST(round(CASE decision WHEN 'STRONG_BUY' THEN 100 WHEN 'BUY' THEN 80 WHEN 'ACCUMULATE' THEN 60 ELSE 40 END + round(prob_20d * 100, 0) + reward_risk * 10, 0) AS BIGINT)",
        "alpha": "CAST(round(prob_20d * 100 + reward_risk * 20 + atr_p * 500, 0) AS BIGINT)",
        "est_beta": near("1.35 + atr_p * 25", 2),
        "target_percent": near("(target - close) / close * 100", 1),
        "stop_percent": near("(close - stop_loss) / close * 100", 1),
    },
]
#: The data's swings are far wider than a stock's, so the limits are parameters.
CALM = "sells = 0 AND downside <= {downside} AND atr_p <= {atr} AND drawdown <= {drawdown}"
WIDE = {"downside": 0.65, "atr": 30.0, "drawdown": 1.0}
LIVELY = "sells = 0 AND (atr_p >= {atr} OR reward_risk >= {rr})"


def ranked(spark, sf_dir) -> DataFrame:
    return layered(rated(spark, sf_dir), RANKING)


def rank_low_risk(spark, sf_dir):
    calm = ranked(spark, sf_dir).where(CALM.format(**WIDE))
    size = F.count("*").over(features.Window.partitionBy("bar"))
    best = top(calm.withColumn("size", size), ["bar"], [F.desc("low_risk"), F.col("symbol")], 10)
    percentile = F.round(100 - (F.col("rank") - 1) / F.col("size") * 100, 1)
    return rounded(best.select("bar", "symbol", F.col("rank").cast("long").alias("rank"), "low_risk", "decision", "conviction", percentile.alias("percentile")))


def rank_high_alpha(spark, sf_dir):
    lively = ranked(spark, sf_dir).where(LIVELY.format(atr=0.022, rr=2.0))
    best = top(lively, ["bar"], [F.desc("high_alpha"), F.col("symbol")], 5)
    return rounded(best.select("bar", "symbol", F.col("rank").cast("long").alias("rank"), "high_alpha", "alpha", "est_beta", "target_percent", "stop_percent"))


def universe_rank(spark, sf_dir):
    place = F.row_number().over(features.Window.partitionBy("bar").orderBy(F.desc("prob_20d"), "symbol"))
    size = F.count("*").over(features.Window.partitionBy("bar"))
    df = scoring.score(state(spark, sf_dir)).select("bar", "symbol", "prob_20d", place.cast("long").alias("rank"), size.alias("size"))
    return rounded(df.withColumn("percentile", F.round(100 - (F.col("rank") - 1) / F.col("size") * 100, 1)))


def market_movers(spark, sf_dir):
    quotes = tables.quotes(tables.bars(spark, sf_dir)).withColumn("change", F.col("price") / F.col("prev_close") - 1)
    lists = [("GAINERS", [F.desc("change"), "symbol"]), ("LOSERS", [F.asc("change"), "symbol"]), ("ACTIVE", [F.desc("volume"), "symbol"])]
    parts = [quotes.orderBy(*order).limit(10).select(F.lit(name).alias("list"), "symbol", "change", "volume") for name, order in lists]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def symbol_profile(spark, sf_dir):
    df = latest(state(spark, sf_dir).select("symbol", "bar", "close", "rsi_14", "macd_hist", "sma_20_dist", "sma_50_dist", "bb_width", "atr_14", "vol_20d"), ["symbol"], "bar")
    return rounded(df)


def row_fingerprint(spark, sf_dir):
    """A digest of each bar's features as a JSON object in name order, at six decimals, for finding changed rows."""
    names = sorted(features.DEFAULTS)
    df = features.feature_panel(panel := tables.bars(spark, sf_dir), tables.benchmark(panel))
    six = {c: F.expr(f"CAST(CAST(floor({c} * 1000000 + 0.5) AS DECIMAL(20, 0)) * CAST('0.000001' AS DECIMAL(7, 6)) AS STRING)") for c in names}
    text = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{c}":'), e) for c, e in six.items()]), F.lit("}"))
    return rounded(df.select("symbol", "bar", F.sha2(text, 256).alias("digest")))


QUERIES = {f.__name__: f for f in (
    scored_signals, risk_levels, decisions, scenarios, feature_contributions, evidence, movement_catalyst, rank_low_risk, rank_high_alpha,
    universe_rank, market_movers, symbol_profile, row_fingerprint,
)}

B = "symbol, bar::VARCHAR AS bar"
_OF = {c: "(rsi_14 - 50) * 0.005" if c == "rsi_14" else f"{c} * 0.12" if c == "news_sentiment" else f"{c} * 1.2" for c in scoring.FACTORS}
ORACLE_SQL = {
    "scored_signals": sql(f"SELECT {B}, signal_quality, data_quality, {r(SCORED)} FROM ({nested('state', scoring.SCORES)})"),
    "risk_levels": sql(f"SELECT {B}, risk_score, risk_state, illiquid, {r(RISKS)} FROM rated", **LOCAL),
    "decisions": sql(f"SELECT {B}, regime, decision FROM rated", **LOCAL),
    "scenarios": sql(
        f"SELECT {B}, {r('bull_return base_return bear_return bull_prob base_prob bear_prob bull_price base_price bear_price support')} FROM ({nested('state', scoring.SCORES + scoring.SCENARIOS)})"
    ),
    "feature_contributions": sql(
        f"SELECT {B}, row_number() OVER (PARTITION BY symbol, bar ORDER BY abs(contribution) DESC, factor) - 1 AS place, factor, contribution + 0.0 AS contribution FROM ("
        + " UNION ALL ".join(f"SELECT symbol, bar, '{c}' AS factor, round(greatest(-0.25, least(0.25, coalesce({e}, 0))), 3)::DOUBLE AS contribution FROM state" for c, e in _OF.items())
        + ")"
    ),
    "evidence": sql(
        f"""SELECT {B}, kind, text, weight FROM (
        SELECT s.symbol, bar, 'NEWS' AS kind, '[' || n.event || '] ' || n.headline || ' (sentiment ' || CASE WHEN n.score > 0 THEN '+' ELSE '' END || n.score || ', severity ' || n.severity || ')' AS text, 0.30::DOUBLE AS weight
          FROM full_state s JOIN told n USING (symbol) WHERE n.headline IS NOT NULL
        UNION ALL SELECT symbol, bar, 'TECHNICAL' AS kind, 'RSI(14) at ' || round(rsi_14, 1)::DECIMAL(20,1)::VARCHAR || ', ' || CASE WHEN rsi_14 > 70 THEN 'overbought' WHEN rsi_14 < 30 THEN 'oversold' ELSE 'balanced' END AS text, 0.25::DOUBLE AS weight FROM full_state
        UNION ALL SELECT symbol, bar, 'TREND', CASE WHEN sma_50_dist >= 0 THEN '+' ELSE '' END || round(sma_50_dist * 100, 1)::DECIMAL(20,1)::VARCHAR || '% from the 50-bar mean', 0.20 FROM full_state
        UNION ALL SELECT symbol, bar, 'LIQUIDITY', 'volume z-score ' || CASE WHEN volume_z_score >= 0 THEN '+' ELSE '' END || round(volume_z_score, 1)::DECIMAL(20,1)::VARCHAR || ', ' || CASE WHEN volume_z_score > 1.5 THEN 'far above usual' ELSE 'unusual' END, 0.15 FROM full_state WHERE abs(volume_z_score) > 1
        UNION ALL SELECT symbol, bar, 'REGIME', 'regime ' || regime, 0.10 FROM full_state)""",
        **LOCAL, told=TOLD, news=NEWS, named=NAMED,
    ),
    "movement_catalyst": sql(
        f"SELECT {B}, direction, round(surge, 6) AS surge, catalyst, confidence, legacy_confidence FROM ({nested('vols', scoring.SCORES + scoring.CATALYST)})",
        vols="SELECT *, avg(volume) OVER (PARTITION BY symbol ORDER BY bar ROWS 19 PRECEDING) AS avg_volume FROM state",
    ),
    "rank_low_risk": sql(
        f"""SELECT bar::VARCHAR AS bar, symbol, rank, low_risk + 0.0 AS low_risk, decision, conviction, round(100 - (rank - 1) / size * 100, 1) AS percentile FROM (
        SELECT *, row_number() OVER (PARTITION BY bar ORDER BY low_risk DESC, symbol) AS rank, count(*) OVER (PARTITION BY bar) AS size FROM ({nested('rated', RANKING)}) WHERE {CALM.format(**WIDE)}) WHERE rank <= 10""",
        **LOCAL,
    ),
    "rank_high_alpha": sql(
        f"""SELECT bar::VARCHAR AS bar, symbol, rank, high_alpha + 0.0 AS high_alpha, alpha, est_beta, target_percent, stop_percent FROM (
        SELECT *, row_number() OVER (PARTITION BY bar ORDER BY high_alpha DESC, symbol) AS rank FROM ({nested('rated', RANKING)}) WHERE {LIVELY.format(atr=0.022, rr=2.0)}) WHERE rank <= 5""",
        **LOCAL,
    ),
    "universe_rank": sql(
        f"""SELECT bar::VARCHAR AS bar, symbol, prob_20d + 0.0 AS prob_20d, rank, size, round(100 - (rank - 1) / size * 100, 1) AS percentile FROM (
        SELECT *, row_number() OVER (PARTITION BY bar ORDER BY prob_20d DESC, symbol) AS rank, count(*) OVER (PARTITION BY bar) AS size FROM ({nested('state', scoring.SCORES)}))"""
    ),
    "market_movers": sql(
        """SELECT list, symbol, round(change, 6) AS change, volume FROM (
        (SELECT 'GAINERS' AS list, symbol, price / prev_close - 1 AS change, volume FROM quotes ORDER BY change DESC, symbol LIMIT 10)
        UNION ALL (SELECT 'LOSERS', symbol, price / prev_close - 1 AS change, volume FROM quotes ORDER BY change, symbol LIMIT 10)
        UNION ALL (SELECT 'ACTIVE', symbol, price / prev_close - 1 AS change, volume FROM quotes ORDER BY volume DESC, symbol LIMIT 10))"""
    ),
    "symbol_profile": sql(
        f"SELECT {B}, {r('close rsi_14 macd_hist sma_20_dist sma_50_dist bb_width atr_14 vol_20d')} FROM state QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar DESC) = 1"
    ),
    "row_fingerprint": sql(
        f"SELECT {B}, sha256('{{' || concat_ws(',', " + ", ".join(f"""'"{c}":' || (floor({c} * 1000000 + 0.5)::DECIMAL(20, 0) * 0.000001::DECIMAL(7, 6))::VARCHAR""" for c in sorted(features.DEFAULTS)) + ") || '}') AS digest FROM panel"
    ),
}
