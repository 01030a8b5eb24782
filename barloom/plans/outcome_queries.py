"""Queries on outcomes, metrics, fitted tables, portfolios, headlines and searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import rounded
from barloom.operators import joins, labels, news, outcomes, portfolio, quantiles, scoring
from barloom.plans.data_queries import NAMED, POSITIONS, decimals, named, positions
from barloom.plans.news_sql import NEWS, TOLD
from barloom.plans.oracle import layered as nested
from barloom.plans.oracle import rounded as r
from barloom.plans.oracle import sql
from barloom.plans.score_queries import LOCAL, rated
from barloom.operators.features import feature_panel
from barloom.sources import tables

H = {"1d": 1, "5d": 5, "20d": 20}


def scored(spark, sf_dir) -> DataFrame:
    """Probabilities by horizon with the net outcome they were to foretell, by walk-forward partition."""
    panel = tables.bars(spark, sf_dir)
    df = feature_panel(panel, tables.benchmark(panel)).withColumns({"news_sentiment": F.lit(None).cast("double"), "atr_14": F.lit(None).cast("double")})
    df = labels.by_progress(labels.forward_labels(scoring.score(df)), step=1)
    long = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"prob_{h}").alias("prob"), F.col(f"gross_{h}").alias("ret"), F.col(f"target_{h}").alias("outcome")) for h in H])
    df = df.select("symbol", "bar", "partition", "close", "atr_percent", F.explode(long).alias("x")).select("symbol", "bar", "partition", "close", "atr_percent", "x.*")
    return df.where("ret IS NOT NULL")


SCORES_ONLY = [{c: e for c, e in layer.items() if c.startswith(("raw", "prob"))} for layer in scoring.SCORES[:2]]
SCORED = (
    """SELECT symbol, bar, partition, close, atr_percent, horizon, prob, ret, (ret - """
    + repr(labels.round_trip_cost())
    + """ > 0)::INT::DOUBLE AS outcome FROM ("""
    + " UNION ALL ".join(f"SELECT symbol, bar, partition, close, atr_percent, '{h}' AS horizon, prob_{h} AS prob, g{n} AS ret FROM parted" for h, n in H.items())
    + ") WHERE ret IS NOT NULL"
)
PARTED = f"""SELECT *, CASE WHEN p < 0.5 THEN 'TRAIN' WHEN p < 0.75 THEN 'VALIDATION' WHEN p < 0.9 THEN 'TEST' ELSE 'HOLDOUT' END AS partition FROM (
  SELECT *, (rn - 55) / nullif(n - 76, 0)::DOUBLE AS p FROM (
    SELECT *, count(*) OVER (PARTITION BY symbol) AS n, {', '.join(f'lead(close, {n}) OVER ws / close - 1 AS g{n}' for n in H.values())}
    FROM ({nested('plain_state', SCORES_ONLY)}) WINDOW ws AS (PARTITION BY symbol ORDER BY bar))
  WHERE rn >= 55 AND rn <= n - 21 AND n > 76)"""
S = {"plain_state": "SELECT panel.*, CAST(NULL AS DOUBLE) AS news_sentiment FROM panel", "parted": PARTED, "scored": SCORED}


def signals(spark, sf_dir) -> DataFrame:
    """Long and short signals with barriers of a tenth and a fifteenth of the usual range, and the bars that follow."""
    panel = tables.bars(spark, sf_dir)
    df = scored(spark, sf_dir).where("prob >= 0.55 OR prob <= 0.45").join(outcomes.with_path(panel).select("symbol", "bar", "path"), ["symbol", "bar"])
    side = F.when(F.col("prob") >= 0.55, "LONG").otherwise("SHORT")
    sign = F.when(F.col("prob") >= 0.55, 1.0).otherwise(-1.0)
    step = F.least(F.col("atr_percent"), F.lit(5.0)) * F.col("close")
    of = F.create_map(*[F.lit(x) for pair in H.items() for x in pair])
    return df.withColumns({"side": side, "stop": F.col("close") - sign * 0.1 * step, "target": F.col("close") + sign * 0.15 * step, "h": of[F.col("horizon")]})


def trades(spark, sf_dir) -> DataFrame:
    return outcomes.path_outcomes(signals(spark, sf_dir))


SIGNALS = """SELECT *, CASE WHEN prob >= 0.55 THEN 'LONG' ELSE 'SHORT' END AS side, close - sg * 0.1 * st AS stop, close + sg * 0.15 * st AS target,
  CASE horizon WHEN '1d' THEN 1 WHEN '5d' THEN 5 ELSE 20 END AS h FROM (SELECT s.*, b.rn, CASE WHEN prob >= 0.55 THEN 1.0 ELSE -1.0 END::DOUBLE AS sg, least(atr_percent, 5.0) * s.close AS st
  FROM scored s JOIN bars_n b USING (symbol, bar) WHERE prob >= 0.55 OR prob <= 0.45)"""
TOUCHED = """SELECT s.symbol, s.bar, s.horizon, arg_min(row(b.bar, is_stop), b.rn) AS f FROM (
  SELECT s.symbol, s.bar, s.horizon, s.side, b.rn, b.bar AS bb, CASE WHEN side = 'LONG' THEN b.low <= stop ELSE b.high >= stop END AS is_stop,
    CASE WHEN side = 'LONG' THEN b.high >= target ELSE b.low <= target END AS is_target, b.bar AS bbar FROM sig s JOIN bars_n b ON s.symbol = b.symbol AND b.rn BETWEEN s.rn + 1 AND s.rn + s.h) s
  JOIN bars_n b ON b.symbol = s.symbol AND b.rn = s.rn WHERE is_stop OR is_target GROUP BY s.symbol, s.bar, s.horizon"""
TRADES = """SELECT *, CASE WHEN side = 'LONG' THEN exit_price / close - 1 ELSE 1 - exit_price / close END AS gross,
  CASE WHEN side = 'LONG' THEN exit_price * (1 - 0.0005 - 0.0003 - 0.0010) / (close * (1 + 0.0005 + 0.0003)) - 1 ELSE (close * (1 - 0.0005 - 0.0003 - 0.0010) - exit_price * (1 + 0.0005 + 0.0003)) / close END AS net FROM (
  SELECT s.*, coalesce(struct_extract_at(f, 1), l.bar) AS exit_bar, CASE WHEN f IS NULL THEN 'HORIZON_EXPIRY' WHEN struct_extract_at(f, 2) THEN 'STOP_LOSS' ELSE 'TARGET_PROFIT' END AS exit_reason,
    CASE WHEN f IS NULL THEN l.close WHEN struct_extract_at(f, 2) THEN stop ELSE target END AS exit_price
  FROM sig s LEFT JOIN touched t ON t.symbol = s.symbol AND t.bar = s.bar AND t.horizon = s.horizon JOIN bars_n l ON l.symbol = s.symbol AND l.rn = s.rn + s.h)"""
T = S | {"sig": SIGNALS, "touched": TOUCHED, "fills": TRADES}


def path_outcomes(spark, sf_dir):
    return rounded(trades(spark, sf_dir).select("symbol", "bar", "horizon", "side", "exit_reason", "exit_bar", "exit_price", "gross", "net"))


#: Horizons of :func:`long_path_outcomes`.
LONG = (20, 60, 250)


def long_path_outcomes(spark, sf_dir):
    """Every bar as a signal, long and short in turn, for 20, 60 or 250 bars, with barriers far enough to be met late or never."""
    panel = tables.bars(spark, sf_dir)
    week = F.datediff("bar", F.lit("1992-01-06").cast("date")) / 7
    k = week.cast("int")
    side = F.when(k % 2 == 0, "LONG").otherwise("SHORT")
    signs = panel.select("symbol", "bar", "close", side.alias("side"), F.element_at(F.array(*[F.lit(h) for h in LONG]), (k % 3 + 1).cast("int")).alias("h"))
    low, high = F.col("close") * 0.02, F.col("close") * 12
    signs = signs.withColumns({"stop": F.when(F.col("side") == "LONG", low).otherwise(high), "target": F.when(F.col("side") == "LONG", high).otherwise(low)})
    done = outcomes.long_path_outcomes(signs, panel, max(LONG))
    return rounded(done.select("symbol", "bar", "h", "side", "exit_reason", "exit_bar", "exit_price", "net"))


def signal_outcomes(spark, sf_dir):
    five = scored(spark, sf_dir).where("horizon = '5d' AND partition IN ('TEST', 'HOLDOUT')")
    return rounded(outcomes.signal_outcomes(five, "ret", "atr_percent", labels.round_trip_cost()).select("symbol", "bar", "exit_reason", "exit_price", "net"))


def metrics_by_partition(spark, sf_dir):
    """Trades by partition and horizon, with subtotals."""
    t = trades(spark, sf_dir)
    return rounded(outcomes.trade_metrics(trades(spark, sf_dir), ["partition", "horizon"], [["horizon"]]))


def risk_by_horizon(spark, sf_dir):
    df = outcomes.risk_metrics(trades(spark, sf_dir), ["horizon"], ["exit_bar", "symbol", "bar"], F.greatest(F.lit(1.0), F.floor(F.col("n") / 4).cast("double")))
    return rounded(df)


def equity_curve(spark, sf_dir):
    df = outcomes.equity_curve(trades(spark, sf_dir), ["horizon"], ["exit_bar", "symbol", "bar"], 0.05)
    return rounded(df.select("horizon", "symbol", "bar", "exit_bar", "equity", "drawdown"))


def calibration_metrics(spark, sf_dir):
    return rounded(outcomes.calibration_metrics(scored(spark, sf_dir), ["horizon", "partition"]))


def reliability_curve(spark, sf_dir):
    return rounded(outcomes.calibration_bins(scored(spark, sf_dir), ["horizon"]))


def auc_accuracy(spark, sf_dir):
    return rounded(outcomes.auc(scored(spark, sf_dir), ["horizon"]))


def empirical_buckets(spark, sf_dir):
    return rounded(outcomes.fit_buckets(scored(spark, sf_dir).where("partition = 'VALIDATION'")))


def expected_return(spark, sf_dir):
    """Expected values of test rows by the buckets that validation rows gave."""
    df = scored(spark, sf_dir)
    buckets = outcomes.fit_buckets(df.where("partition = 'VALIDATION'"))
    five = joins.lookup_buckets(df.where("partition = 'TEST' AND horizon = '5d'"), buckets)
    shown = "market_vol gain loss expected_value ci_low ci_high uncertainty".split()
    return rounded(scoring.expected_return(five, "prob", "atr_percent", 5).select("symbol", "bar", "method", "samples", *shown))


def binned_isotonic(spark, sf_dir):
    return rounded(outcomes.fit_binned_isotonic(scored(spark, sf_dir).where("partition = 'VALIDATION'")))


def calibrated(spark, sf_dir):
    """Test probabilities through knots fitted on validation rows."""
    df = scored(spark, sf_dir)
    knots = outcomes.fit_binned_isotonic(df.where("partition = 'VALIDATION'"))
    return rounded(joins.calibrate(df.where("partition = 'TEST'"), knots).select("symbol", "bar", "horizon", "prob", "calibrated"))


def return_quantiles(spark, sf_dir):
    q = F.percentile("ret", F.array(F.lit(0.85), F.lit(0.5), F.lit(0.15)))
    return rounded(scored(spark, sf_dir).groupBy("horizon").agg(q.alias("q")).select("horizon", *[F.get("q", F.lit(k)).alias(n) for k, n in enumerate(("bull", "base", "bear"))]))


def quantile_windows(spark, sf_dir):
    """Quantiles of the last twelve months' returns, by horizon and month: the exact ones, and whether merged sketches of months come as near as their bound says.

    Many windows are asked for, so three times the bound of 99 percent is allowed.
    """
    ranks, rows = [0.85, 0.5, 0.15], scored(spark, sf_dir)
    told = quantiles.windowed(quantiles.monthly(rows, ["horizon"], "ret", "bar"), ["horizon"], 12)
    measured = quantiles.off_by(rows, told, ["horizon"], "ret", "bar", 12, ranks).select("horizon", "month", "n", (F.col("error") <= 3 * quantiles.rank_error() + 1 / F.col("n")).alias("within"))
    truth = quantiles.exact(rows, ["horizon"], "ret", "bar", 12, ranks)
    shown = [F.get("exact", F.lit(k)).alias(n) for k, n in enumerate(("bull", "base", "bear"))]
    return rounded(measured.join(truth, ["horizon", "month"]).select("horizon", "month", "n", *shown, "within"))


def benchmark_return(spark, sf_dir):
    df = tables.bars(spark, sf_dir).groupBy("symbol").agg(F.min_by("close", "bar").alias("first"), F.max_by("close", "bar").alias("last"), F.count("*").alias("n"))
    return rounded(df.select("symbol", "n", (F.pow(F.col("last") / F.col("first"), 252 / F.col("n")) - 1).alias("annual_return")))


def model_comparison(spark, sf_dir):
    """The heuristic and the fallback score on test rows."""
    panel = tables.bars(spark, sf_dir)
    df = feature_panel(panel, tables.benchmark(panel)).withColumns({"news_sentiment": F.lit(None).cast("double"), "atr_14": F.lit(None).cast("double")})
    df = labels.by_progress(labels.forward_labels(scoring.score(df)), step=1).where("partition = 'TEST'")
    both = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("prob")) for m, c in (("heuristic", "prob_5d"), ("fallback", "fallback_5d"))])
    df = df.select(F.explode(both).alias("m"), F.col("target_5d").alias("outcome")).select("m.*", "outcome").where("outcome IS NOT NULL")
    return rounded(outcomes.calibration_metrics(df, ["model"]).select("model", "n", "brier", "ece"))


def position_values(spark, sf_dir):
    return decimals(rounded(joins.value_positions(positions(spark, sf_dir), tables.quotes(tables.bars(spark, sf_dir)))))


def portfolio_summary(spark, sf_dir):
    return decimals(rounded(portfolio.summary(joins.value_positions(positions(spark, sf_dir), tables.quotes(tables.bars(spark, sf_dir))))))


def sector_drilldown(spark, sf_dir):
    valued = joins.value_positions(positions(spark, sf_dir), tables.quotes(tables.bars(spark, sf_dir)))
    return decimals(rounded(portfolio.drill_down(valued, tables.universe(spark, sf_dir))))


def concentration(spark, sf_dir):
    valued = joins.value_positions(positions(spark, sf_dir), tables.quotes(tables.bars(spark, sf_dir)))
    return rounded(portfolio.concentration(valued, tables.universe(spark, sf_dir)))


def ledger_replay(spark, sf_dir):
    return portfolio.replay(tables.transactions(spark, sf_dir))


def exit_signals(spark, sf_dir):
    held = joins.value_positions(positions(spark, sf_dir), tables.quotes(tables.bars(spark, sf_dir)))
    held = held.withColumn("target_price", F.col("average").cast("double") * 1.5)
    last = joins.latest(rated(spark, sf_dir).select("symbol", "bar", "decision", "downside", "stop_loss", "target", "risk_score", "risk_state"), ["symbol"], "bar")
    return rounded(portfolio.exit_signals(held, last))


def bracket_levels(spark, sf_dir):
    buys = tables.transactions(spark, sf_dir).where("side = 'BUY'").select("portfolio", "symbol", "ts", F.col("price").cast("double").alias("price"))
    last = tables.quotes(tables.bars(spark, sf_dir)).select("symbol", F.col("low").alias("model_stop"), F.col("high").alias("model_target"))
    return rounded(portfolio.brackets(buys.join(last, "symbol")))


def trade_summary(spark, sf_dir):
    value = (F.col("qty") * F.col("price")).cast("decimal(18,2)")
    df = tables.transactions(spark, sf_dir).groupBy("portfolio").agg(
        F.count("*").alias("trades"),
        F.sum(value).cast("double").alias("turnover"),
        F.sum(F.when(F.col("side") == "BUY", F.col("qty"))).alias("bought"),
        F.sum(F.when(F.col("side") == "SELL", F.col("qty"))).alias("sold"),
    )
    return rounded(df)


def classify_headlines(spark, sf_dir):
    df = news.classify(tables.headlines(spark, sf_dir))
    return df.select("id", "category", "sentiment", "impact", "article_id", "source", F.length("title").cast("long").alias("title_length"))


def symbol_sentiment(spark, sf_dir):
    return news.symbol_sentiment(news.classify(tables.headlines(spark, sf_dir)), named(tables.universe(spark, sf_dir)))


def time_ago(spark, sf_dir):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return tables.ticks(spark, sf_dir).select("seq", news.time_ago(F.col("ts"), now).alias("ago"))


def search_universe(spark, sf_dir):
    u = tables.universe(spark, sf_dir)
    q = "eco"
    hit = F.lower("symbol").contains(q) | F.lower("name").contains(q) | F.lower("sector").contains(q)
    return u.where(hit).orderBy("rank").limit(30).withColumn("rank", F.col("rank").cast("long"))


def screener(spark, sf_dir):
    u = tables.universe(spark, sf_dir)
    return u.where((F.col("tier") == "MID") & (F.col("rank") <= 20)).orderBy("rank").offset(2).limit(5).withColumn("rank", F.col("rank").cast("long"))


def filter_news(spark, sf_dir):
    df = news.classify(tables.headlines(spark, sf_dir))
    return df.where((F.col("category") == "Macro") & F.lower("title").contains("the")).orderBy("id").limit(30).select("id", "category", "source")


def news_for_symbol(spark, sf_dir):
    tagged = joins.tag_headlines(tables.headlines(spark, sf_dir), named(tables.universe(spark, sf_dir)))
    return tagged.where((F.col("affected") == "Brand#1") | F.lower("title").contains("brand#1")).select("id", "affected")


def trade_history(spark, sf_dir):
    """A page of a portfolio's journal, newest first, largest first within a day."""
    df = tables.transactions(spark, sf_dir).where("side = 'BUY'").orderBy(F.desc("ts"), F.desc("price"), "portfolio", "qty").offset(10).limit(20)
    return decimals(rounded(df.select("portfolio", "symbol", "ts", "qty", "price")))


def active_alerts(spark, sf_dir):
    """Alerts (a price per holding) that the latest quote has met."""
    quotes = tables.quotes(tables.bars(spark, sf_dir)).select("symbol", F.col("price").alias("quote"))
    alerts = positions(spark, sf_dir).select("portfolio", "symbol", F.col("average").cast("double").alias("level"), F.when(F.col("qty") % 2 == 0, "ABOVE").otherwise("BELOW").alias("condition"))
    met = F.when(F.col("condition") == "ABOVE", F.col("quote") >= F.col("level")).otherwise(F.col("quote") <= F.col("level"))
    return rounded(alerts.join(quotes, "symbol").where(met))


def model_gates(spark, sf_dir):
    """Which horizons' scores are fit for use, and why not: samples, bins and calibration error on validation rows."""
    m = outcomes.calibration_metrics(scored(spark, sf_dir).where("partition = 'VALIDATION'"), ["horizon"])
    reasons = F.array(F.when(F.col("n") < 20, "samples"), F.when(F.col("populated_bins") < 2, "bins"), F.when(F.col("ece") > 0.35, "ece"))
    return m.select("horizon", "n", F.array_join(F.filter(reasons, lambda x: x.isNotNull()), ",").alias("blocking"))


def resolved_predictions(spark, sf_dir):
    """How often each symbol's predictions came true."""
    return rounded(scored(spark, sf_dir).groupBy("symbol", "horizon").agg(F.count("*").alias("n"), F.avg(((F.col("prob") >= 0.5) == (F.col("ret") > 0)).cast("double")).alias("correct")))


QUERIES = {f.__name__: f for f in (
    path_outcomes, signal_outcomes, metrics_by_partition, risk_by_horizon, equity_curve, calibration_metrics, reliability_curve, auc_accuracy,
    empirical_buckets, expected_return, binned_isotonic, calibrated, return_quantiles, quantile_windows, long_path_outcomes, benchmark_return, model_comparison, position_values,
    portfolio_summary, sector_drilldown, concentration, ledger_replay, exit_signals, bracket_levels, trade_summary, classify_headlines, symbol_sentiment, time_ago,
    search_universe, screener, filter_news, news_for_symbol, trade_history, active_alerts, model_gates, resolved_predictions,
)}


VALUED = """SELECT p.*, cur AS current_price, (qty * average)::DECIMAL(18,2) AS invested, (qty * cur2)::DECIMAL(18,2) AS current_value, (qty * today)::DECIMAL(18,2) AS today_pnl FROM (
  SELECT p.*, cur, cur::DECIMAL(18,2) AS cur2, (cur - coalesce(nullif(prev_close, 0), cur))::DECIMAL(18,2) AS today FROM (
    SELECT p.*, coalesce(nullif(q.price, 0), p.average::DOUBLE) AS cur, q.prev_close FROM held p LEFT JOIN quotes q USING (symbol)) p) p"""
VALUED = VALUED.replace("cur::DECIMAL(18,2)", "cur::DECIMAL(18,2)")
P = {"held": POSITIONS, "valued": VALUED}
PNL = "CASE WHEN invested > 0 THEN round((current_value - invested)::DOUBLE / invested::DOUBLE * 100, 2) ELSE 0 END"
METRICS = """count(*) AS trades, round(avg((gross > 0)::INT) * 100, 6) AS win_rate, round(avg(net) FILTER (net > 0) * 100, 6) AS avg_gain, round(avg(net) FILTER (net <= 0) * 100, 6) AS avg_loss,
  round(avg(net) * 100, 6) AS avg_return, round(avg((exit_reason = 'TARGET_PROFIT')::INT) * 100, 6) AS target_hit_rate,
  round(coalesce(coalesce(sum(net) FILTER (net > 0), 0) / nullif(abs(sum(net) FILTER (net <= 0)), 0), CASE WHEN sum(net) FILTER (net > 0) > 0 THEN 99 ELSE 0 END), 6) AS profit_factor"""
BIN = "least(7, floor(prob * 8))::INT"
CALIBRATED = "count(*) AS k, sum(n) AS n, sum(se) / sum(n) AS brier, sum(abs(sp - sy)) / sum(n) AS ece, max(abs(sp - sy) / n) AS mce"
CURVE = """SELECT *, equity / greatest(100, max(equity) OVER w) - 1 AS drawdown FROM (
  SELECT *, 100 * exp(sum(ln(greatest(1e-9, 1 + 0.05 * net))) OVER w) AS equity FROM fills WINDOW w AS (PARTITION BY horizon ORDER BY exit_bar, symbol, bar ROWS UNBOUNDED PRECEDING))
  WINDOW w AS (PARTITION BY horizon ORDER BY exit_bar, symbol, bar ROWS UNBOUNDED PRECEDING)"""
EDGES = " UNION ALL ".join(
    f"SELECT '{k}' AS kind, {lo}::DOUBLE AS low, {hi}::DOUBLE AS high, {n} AS least"
    for k, lo, hi, n in [("HORIZON_WIDE", 0.0, 1.0, 5), ("BROAD", 0.0, 0.45, 5), ("BROAD", 0.45, 0.55, 5), ("BROAD", 0.55, 1.0, 5), *[("FINE", round(0.2 + 0.1 * i, 2), round(0.3 + 0.1 * i, 2), 15) for i in range(7)]]
)
BUCKETS = """SELECT horizon, kind, low, high, coalesce(round(avg(abs(ret)) FILTER (keep AND ret > 0), 4), 0.02) AS gain, coalesce(round(avg(abs(ret)) FILTER (keep AND ret <= 0), 4), 0.015) AS loss,
  round(stddev_samp(ret), 4) AS dispersion, round(stddev_samp(ret) / sqrt(count(*)), 4) AS uncertainty, count(*) AS n FROM (
  SELECT *, place > floor(size * 0.1) AND place <= size - floor(size * 0.1) AS keep FROM (
    SELECT *, row_number() OVER (PARTITION BY horizon, kind, low, high, ret > 0 ORDER BY abs(ret)) AS place, count(*) OVER (PARTITION BY horizon, kind, low, high, ret > 0) AS size
    FROM scored JOIN edges ON kind = 'HORIZON_WIDE' OR (prob >= low AND (prob < high OR (kind = 'BROAD' AND prob <= high))) WHERE partition = 'VALIDATION'))
  GROUP BY horizon, kind, low, high, least HAVING count(*) >= least"""
BINS8 = """SELECT horizon, bin, sum(prob) AS sp, sum(outcome) AS sy, count(*) AS n FROM (SELECT *, least(7, floor(place / greatest(1, floor(size / 8))))::INT AS bin FROM (
  SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY prob, outcome) - 1 AS place, count(*) OVER (PARTITION BY horizon) AS size FROM scored WHERE partition = 'VALIDATION')) GROUP BY ALL"""
KNOTS = """SELECT horizon, x, max(y) OVER (PARTITION BY horizon ORDER BY x ROWS UNBOUNDED PRECEDING) AS y, n FROM (
  SELECT * FROM blocks UNION ALL
  SELECT horizon, 0.05, round(greatest(0.05, arg_min(y, x) - (min(x) - 0.05) * 0.8), 3), 0 FROM blocks GROUP BY horizon HAVING min(x) > 0.05 UNION ALL
  SELECT horizon, 0.95, round(least(0.95, arg_max(y, x) + (0.95 - max(x)) * 0.8), 3), 0 FROM blocks GROUP BY horizon HAVING max(x) < 0.95)"""
BLOCKS = """
  SELECT horizon, round(greatest(0.05, least(0.95, sum(sp) / sum(n))), 3) AS x, round(greatest(0.08, least(0.92, CASE WHEN sum(n) < 15 THEN (y * sum(n) + 5.0) / (sum(n) + 10) ELSE y END)), 3) AS y, sum(n)::BIGINT AS n FROM (
    SELECT horizon, bin, any_value(sp) AS sp, any_value(n) AS n, round(max(low), 10) AS y FROM (
      SELECT i.horizon, i.bin, s.lo, min(s.mean) AS low, any_value(i.sp) AS sp, any_value(i.n) AS n FROM bins8 i JOIN (
        SELECT j.horizon, j.bin AS lo, k.bin AS hi, sum(m.sy) / sum(m.n) AS mean FROM bins8 j JOIN bins8 k ON j.horizon = k.horizon AND j.bin <= k.bin JOIN bins8 m ON m.horizon = j.horizon AND m.bin BETWEEN j.bin AND k.bin GROUP BY ALL) s
      ON i.horizon = s.horizon AND s.lo <= i.bin AND s.hi >= i.bin GROUP BY i.horizon, i.bin, s.lo) GROUP BY horizon, bin) GROUP BY horizon, y"""
B = "symbol, bar::VARCHAR AS bar"

ORACLE_SQL = {
    "path_outcomes": sql(f"SELECT {B}, horizon, side, exit_reason, exit_bar::VARCHAR AS exit_bar, {r('exit_price gross net')} FROM fills", **T),
    "signal_outcomes": sql(
        f"""SELECT {B}, exit_reason, round(close * (1 + got), 6) + 0.0 AS exit_price, round(got - {labels.round_trip_cost()!r}, 6) + 0.0 AS net FROM (
        SELECT *, CASE exit_reason WHEN 'STOP_LOSS' THEN -1.5 * atr_percent WHEN 'TARGET_HIT' THEN 2.25 * atr_percent ELSE ret END AS got FROM (
        SELECT *, CASE WHEN ret <= -1.5 * atr_percent THEN 'STOP_LOSS' WHEN ret >= 2.25 * atr_percent THEN 'TARGET_HIT' ELSE 'HORIZON_EXPIRY' END AS exit_reason
        FROM scored WHERE horizon = '5d' AND partition IN ('TEST', 'HOLDOUT') AND prob >= 0.55))""",
        **S,
    ),
    "metrics_by_partition": sql(f"SELECT partition, horizon, {METRICS} FROM (SELECT * FROM fills UNION ALL SELECT * REPLACE ('ALL' AS partition) FROM fills) GROUP BY partition, horizon", **T),
    "risk_by_horizon": sql(
        f"""SELECT horizon, n, {r('final cagr max_drawdown')}, round((mean * 252 - 0.065) / (std * sqrt(252)), 6) AS sharpe, round((mean * 252 - 0.065) / (down * sqrt(252)), 6) AS sortino,
        round(abs(cagr / nullif(max_drawdown, 0)), 6) AS calmar FROM (
        SELECT *, pow(greatest(0.01, final / 100), 252 / greatest(1.0, floor(n / 4.0))) - 1 AS cagr FROM (
        SELECT horizon, count(*) AS n, 100 * exp(sum(ln(greatest(1e-9, 1 + 0.05 * net)))) AS final, avg(0.05 * net) AS mean, stddev_pop(0.05 * net) AS std,
        sqrt(sum(pow(0.05 * net, 2)) FILTER (net < 0) / count(*)) AS down, least(0, min(drawdown)) AS max_drawdown FROM curve GROUP BY horizon))""",
        **T, curve=CURVE,
    ),
    "equity_curve": sql(f"SELECT horizon, {B}, exit_bar::VARCHAR AS exit_bar, {r('equity drawdown')} FROM curve", **T, curve=CURVE),
    "calibration_metrics": sql(
        f"""SELECT horizon, partition, n::BIGINT AS n, {r('brier ece mce')}, k AS populated_bins, CASE WHEN ece <= 0.06 AND n >= 50 THEN 'HIGH' WHEN ece <= 0.12 AND n >= 20 THEN 'MEDIUM' ELSE 'POOR' END AS quality FROM (
        SELECT horizon, partition, {CALIBRATED} FROM (SELECT horizon, partition, {BIN} AS bin, count(*) AS n, sum(prob) AS sp, sum(outcome) AS sy, sum(pow(prob - outcome, 2)) AS se FROM scored GROUP BY ALL) GROUP BY ALL)""",
        **S,
    ),
    "reliability_curve": sql(f"SELECT horizon, {BIN} AS bin, count(*) AS n, round(avg(prob), 6) AS mean_prob, round(avg(outcome), 6) AS observed FROM scored GROUP BY ALL", **S),
    "auc_accuracy": sql(
        """SELECT horizon, count(*) AS n, round((sum(rk * outcome) - sum(outcome) * (sum(outcome) + 1) / 2) / (sum(outcome) * (count(*) - sum(outcome))), 6) AS auc,
        round(avg(((prob >= 0.5) = (outcome = 1))::INT), 6) AS accuracy FROM (
        SELECT *, rank() OVER (PARTITION BY horizon ORDER BY prob) + (count(*) OVER (PARTITION BY horizon, prob) - 1) / 2.0 AS rk FROM scored) GROUP BY horizon""",
        **S,
    ),
    "empirical_buckets": sql(f"SELECT horizon, kind, low, high, {r('gain loss dispersion uncertainty')}, n FROM buckets", **S, edges=EDGES, buckets=BUCKETS),
    "expected_return": sql(
        f"""SELECT {B}, coalesce(kind, 'DIFFUSION') AS method, coalesce(n, 0) AS samples, market_vol + 0.0 AS market_vol, g + 0.0 AS gain, l + 0.0 AS loss, round(ev, 4) + 0.0 AS expected_value,
        round(ev - 1.96 * market_vol, 4) + 0.0 AS ci_low, round(ev + 1.96 * market_vol, 4) + 0.0 AS ci_high, coalesce(uncertainty, round(market_vol / sqrt(20), 4)) AS uncertainty FROM (
        SELECT *, greatest(0.01, least(0.99, prob)) * g - (1 - greatest(0.01, least(0.99, prob))) * l AS ev FROM (
        SELECT *, round(coalesce(gain * sc, 0.85 * market_vol)::DECIMAL(20, 8), 4)::DOUBLE AS g, round(coalesce(loss * sc, 0.85 * market_vol)::DECIMAL(20, 8), 4)::DOUBLE AS l FROM (
        SELECT s.symbol, s.bar, s.prob, round(atr_percent * sqrt(5), 4) AS market_vol, greatest(0.35, least(3.5, atr_percent / 0.020)) AS sc, b.* EXCLUDE (horizon, low, high)
        FROM scored s LEFT JOIN buckets b ON b.horizon = s.horizon AND prob >= low AND (prob < high OR (kind <> 'FINE' AND prob <= high)) WHERE s.partition = 'TEST' AND s.horizon = '5d'
        QUALIFY row_number() OVER (PARTITION BY s.symbol, s.bar ORDER BY CASE kind WHEN 'FINE' THEN 0 WHEN 'BROAD' THEN 1 ELSE 2 END, low) = 1)))""",
        **S, edges=EDGES, buckets=BUCKETS,
    ),
    "binned_isotonic": sql(f"SELECT horizon, {r('x y')}, n FROM knots", **S, bins8=BINS8, blocks=BLOCKS, knots=KNOTS),
    "calibrated": sql(
        f"""SELECT {B}, horizon, prob + 0.0 AS prob, CASE WHEN p <= min_x THEN min_y WHEN p >= max_x THEN max_y
        ELSE round(greatest(0.05, least(0.95, y0 + (p - x0) / (x1 - x0) * (y1 - y0)))::DECIMAL(24, 10), 4)::DOUBLE END AS calibrated FROM (
        SELECT s.symbol, s.bar, s.horizon, s.prob, greatest(0.01, least(0.99, s.prob)) AS p, e.*, k.x0, k.y0, k.x1, k.y1 FROM scored s
        JOIN (SELECT horizon AS hz, min(x) AS min_x, max(x) AS max_x, arg_min(y, x) AS min_y, arg_max(y, x) AS max_y FROM knots GROUP BY 1) e ON e.hz = s.horizon
        LEFT JOIN (SELECT horizon, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM knots WINDOW w AS (PARTITION BY horizon ORDER BY x)) k
        ON k.horizon = s.horizon AND greatest(0.01, least(0.99, s.prob)) >= x0 AND greatest(0.01, least(0.99, s.prob)) < x1 WHERE s.partition = 'TEST')""",
        **S, bins8=BINS8, blocks=BLOCKS, knots=KNOTS,
    ),
    "return_quantiles": sql("SELECT horizon, round(quantile_cont(ret, 0.85), 6) AS bull, round(quantile_cont(ret, 0.5), 6) + 0.0 AS base, round(quantile_cont(ret, 0.15), 6) AS bear FROM scored GROUP BY horizon", **S),
    "long_path_outcomes": sql(
        f"""SELECT symbol, bar::VARCHAR AS bar, h, side, reason AS exit_reason, exit_bar::VARCHAR AS exit_bar, round(px, 6) AS exit_price,
        round(CASE WHEN side = 'LONG' THEN px * {1 - outcomes.SLIPPAGE - outcomes.BROKERAGE - outcomes.SELL_TAX!r} / (close * {1 + outcomes.SLIPPAGE + outcomes.BROKERAGE!r}) - 1
          ELSE (close * {1 - outcomes.SLIPPAGE - outcomes.BROKERAGE - outcomes.SELL_TAX!r} - px * {1 + outcomes.SLIPPAGE + outcomes.BROKERAGE!r}) / close END, 6) + 0.0 AS net FROM (
        SELECT s.*, CASE WHEN f.n IS NULL THEN 'HORIZON_EXPIRY' WHEN f.stopped THEN 'STOP_LOSS' ELSE 'TARGET_PROFIT' END AS reason, coalesce(f.bar, e.bar) AS exit_bar,
          CASE WHEN f.n IS NULL THEN e.close WHEN f.stopped THEN s.stop ELSE s.target END AS px
        FROM signed s JOIN placed e ON e.symbol = s.symbol AND e.rn = s.rn + s.h LEFT JOIN firsts f ON f.symbol = s.symbol AND f.rn = s.rn)""",
        placed="SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar) AS rn, (date_diff('day', DATE '1992-01-06', bar) / 7)::BIGINT AS week FROM bars",
        signed=f"""SELECT *, CASE WHEN side = 'LONG' THEN close * 0.02 ELSE close * 12 END AS stop, CASE WHEN side = 'LONG' THEN close * 12 ELSE close * 0.02 END AS target FROM (
          SELECT symbol, bar, close, rn, CASE WHEN week % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS side, {list(LONG)}[week % 3 + 1] AS h FROM placed)""",
        firsts="""SELECT s.symbol, s.rn, min(p.rn) AS n, arg_min(p.bar, p.rn) AS bar, arg_min(CASE WHEN side = 'LONG' THEN p.low <= stop ELSE p.high >= stop END, p.rn) AS stopped
          FROM signed s JOIN placed p ON p.symbol = s.symbol AND p.rn > s.rn AND p.rn <= s.rn + s.h
          WHERE CASE WHEN side = 'LONG' THEN p.low <= stop OR p.high >= target ELSE p.high >= stop OR p.low <= target END GROUP BY s.symbol, s.rn""",
    ),
    "quantile_windows": sql(
        """SELECT horizon, ends::DATE::VARCHAR AS month, count(*) AS n, round(quantile_cont(ret, 0.85), 6) + 0.0 AS bull, round(quantile_cont(ret, 0.5), 6) + 0.0 AS base, round(quantile_cont(ret, 0.15), 6) + 0.0 AS bear, true AS "within"
        FROM (SELECT DISTINCT horizon AS hz, date_trunc('month', bar) AS ends FROM scored) JOIN scored ON horizon = hz AND date_trunc('month', bar) <= ends AND date_trunc('month', bar) > ends - INTERVAL 12 MONTH GROUP BY horizon, ends""",
        **S,
    ),
    "sector_drilldown": sql(
        " UNION ALL ".join(
            f"""SELECT '{level}' AS level, {p} AS portfolio, {s} AS sector, count(*) AS positions, sum(invested)::DOUBLE AS invested, sum(current_value)::DOUBLE AS current_value, sum(today_pnl)::DOUBLE AS today_pnl,
            (sum(current_value) - sum(invested))::DOUBLE AS pnl, {weight} AS weight, {alert} AS alert FROM placed {group}"""
            for level, p, s, weight, alert, group in (
                ("SECTOR_OF_PORTFOLIO", "portfolio", "sec", "round(sum(current_value)::DOUBLE / any_value(whole) * 100, 6)", "(sum(current_value)::DOUBLE / any_value(whole) * 100 >= 40)::INT", "GROUP BY portfolio, sec"),
                ("PORTFOLIO", "portfolio", "NULL", "round(sum(current_value)::DOUBLE / any_value(whole) * 100, 6)", "0", "GROUP BY portfolio"),
                ("SECTOR", "NULL", "sec", "NULL::DOUBLE", "0", "GROUP BY sec"),
                ("ALL", "NULL", "NULL", "NULL::DOUBLE", "0", "HAVING count(*) > 0"),
            )
        ),
        placed="SELECT v.*, coalesce(u.sector, 'General') AS sec, sum(current_value) OVER (PARTITION BY portfolio)::DOUBLE + 1000000 AS whole FROM valued v LEFT JOIN universe u USING (symbol)",
        **P,
    ),
    "benchmark_return": sql("SELECT symbol, count(*) AS n, round(pow(arg_max(close, bar) / arg_min(close, bar), 252.0 / count(*)) - 1, 6) AS annual_return FROM bars GROUP BY symbol"),
    "model_comparison": sql(
        f"""SELECT model, n::BIGINT AS n, round(brier, 6) AS brier, round(ece, 6) AS ece FROM (SELECT model, {CALIBRATED} FROM (
        SELECT model, {BIN} AS bin, count(*) AS n, sum(prob) AS sp, sum(outcome) AS sy, sum(pow(prob - outcome, 2)) AS se FROM (
        SELECT 'heuristic' AS model, prob_5d AS prob, (g5 - {labels.round_trip_cost()!r} > 0)::INT::DOUBLE AS outcome FROM parted WHERE partition = 'TEST'
        UNION ALL SELECT 'fallback', fallback_5d, (g5 - {labels.round_trip_cost()!r} > 0)::INT::DOUBLE FROM parted WHERE partition = 'TEST') WHERE outcome IS NOT NULL GROUP BY ALL) GROUP BY model)""",
        **(S | {"parted": PARTED.replace(nested("plain_state", SCORES_ONLY), nested("plain_state", [{c: e for c, e in layer.items() if c.startswith(("raw", "prob", "fall"))} for layer in scoring.SCORES[:2]]))}),
    ),
    "position_values": sql(
        f"SELECT portfolio, symbol, qty, average::DOUBLE AS average, round(current_price, 6) AS current_price, invested::DOUBLE AS invested, current_value::DOUBLE AS current_value, today_pnl::DOUBLE AS today_pnl, (current_value - invested)::DOUBLE AS pnl, {PNL} + 0.0 AS pnl_percent FROM valued",
        **P,
    ),
    "portfolio_summary": sql(
        f"SELECT portfolio, positions, invested::DOUBLE AS invested, current_value::DOUBLE AS current_value, today_pnl::DOUBLE AS today_pnl, (current_value + 1000000)::DOUBLE AS total_value, (current_value - invested)::DOUBLE AS pnl, {PNL} + 0.0 AS pnl_percent FROM (SELECT portfolio, sum(invested) AS invested, sum(current_value) AS current_value, sum(today_pnl) AS today_pnl, count(*) AS positions FROM valued GROUP BY portfolio)",
        **P,
    ),
    "concentration": sql(
        f"""SELECT portfolio, symbol, sector, {r('weight sector_weight')}, round(weight * 0.2, 6) AS marginal_risk, (weight >= 20)::INT AS position_alert, (sector_weight >= 40)::INT AS sector_alert FROM (
        SELECT portfolio, symbol, sector, v / total * 100 AS weight, sum(v) OVER (PARTITION BY portfolio, sector) / total * 100 AS sector_weight FROM (
        SELECT portfolio, symbol, coalesce(u.sector, 'General') AS sector, current_value::DOUBLE AS v, sum(current_value::DOUBLE) OVER (PARTITION BY portfolio) + 1000000 AS total FROM valued LEFT JOIN universe u USING (symbol)))""",
        **P,
    ),
    "exit_signals": sql(
        """SELECT portfolio, symbol, action, urgency, round(exit_price, 6) AS exit_price FROM (
        SELECT portfolio, symbol, CASE WHEN tg THEN 'TAKE_PROFIT' WHEN st OR em OR decision = 'STRONG_SELL' OR risk_score >= 85 THEN 'STRONG_SELL' WHEN decision = 'REDUCE' THEN 'REDUCE' ELSE 'SELL' END AS action,
        CASE WHEN st OR em OR risk_score >= 85 THEN 'HIGH' WHEN risk_score >= 65 OR downside > 0.60 THEN 'MEDIUM' ELSE 'LOW' END AS urgency, CASE WHEN st OR tg THEN current_price ELSE target END AS exit_price,
        decision IN ('SELL', 'STRONG_SELL', 'REDUCE') OR downside > 0.60 OR st OR tg OR risk_score >= 65 OR em AS leave FROM (
        SELECT v.*, l.* EXCLUDE (symbol), current_price <= stop_loss AS st, current_price >= average::DOUBLE * 1.5 AS tg, risk_state = 'EMERGENCY' AS em FROM valued v
        JOIN (SELECT symbol, decision, downside, stop_loss, target, risk_score, risk_state FROM rated QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar DESC) = 1) l USING (symbol))) WHERE leave""",
        **P, **LOCAL,
    ),
    "bracket_levels": sql(
        """SELECT portfolio, symbol, ts::VARCHAR AS ts, p AS price, round(low, 6) AS model_stop, round(high, 6) AS model_target, round(CASE WHEN low > 0 AND low < p THEN low ELSE p * 0.95 END, 6) AS stop,
        round(CASE WHEN high > p THEN high ELSE p * 1.08 END, 6) AS target FROM (SELECT l.portfolio, symbol, l.ts, l.price::DOUBLE AS p, q.low, q.high FROM ledger l JOIN quotes q USING (symbol) WHERE side = 'BUY')"""
    ),
    "trade_summary": sql(
        "SELECT portfolio, count(*) AS trades, sum(qty * price)::DOUBLE AS turnover, sum(qty) FILTER (side = 'BUY')::BIGINT AS bought, sum(qty) FILTER (side = 'SELL')::BIGINT AS sold FROM ledger GROUP BY portfolio"
    ),
    "classify_headlines": sql("SELECT id, category, sentiment, impact, 'news_' || substr(base64(encode(url)), 1, 16) AS article_id, source, length(title) AS title_length FROM news", news=NEWS),
    "symbol_sentiment": sql(
        "SELECT symbol, score, news, headline, label, level, severity, event FROM told", told=TOLD,
        news=NEWS, named=NAMED,
    ),
    "time_ago": sql(
        """SELECT seq, CASE WHEN m < 1 THEN 'Just now' WHEN m < 60 THEN m::VARCHAR || 'm ago' WHEN m < 1440 THEN (m // 60)::VARCHAR || 'h ago' ELSE (m // 1440)::VARCHAR || 'd ago' END AS ago
        FROM (SELECT seq, floor((epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts))) / 60)::BIGINT AS m FROM ticks)"""
    ),
    "search_universe": sql("SELECT * FROM universe WHERE contains(lower(symbol), 'eco') OR contains(lower(name), 'eco') OR contains(lower(sector), 'eco') ORDER BY rank LIMIT 30"),
    "screener": sql("SELECT * FROM universe WHERE tier = 'MID' AND rank <= 20 ORDER BY rank LIMIT 5 OFFSET 2"),
    "filter_news": sql("SELECT id, category, source FROM news WHERE category = 'Macro' AND contains(t, 'the') ORDER BY id LIMIT 30", news=NEWS),
    "news_for_symbol": sql(
        """SELECT id, affected FROM (SELECT id, title, (SELECT arg_min(u.symbol, u.rank) FROM named u WHERE (length(u.symbol) >= 3 AND contains(lower(title), lower(u.symbol))) OR (length(string_split(u.name, ' ')[1]) >= 4
        AND contains(lower(title), lower(string_split(u.name, ' ')[1])))) AS affected FROM headlines) WHERE affected = 'Brand#1' OR contains(lower(title), 'brand#1')""",
        named=NAMED,
    ),
    "trade_history": sql("SELECT portfolio, symbol, ts::VARCHAR AS ts, qty, price::DOUBLE AS price FROM (SELECT * FROM ledger WHERE side = 'BUY' ORDER BY ts DESC, price DESC, portfolio, qty LIMIT 20 OFFSET 10)"),
    "active_alerts": sql(
        """SELECT portfolio, symbol, level, condition, round(quote, 6) AS quote FROM (SELECT h.portfolio, symbol, average::DOUBLE AS level, CASE WHEN qty % 2 = 0 THEN 'ABOVE' ELSE 'BELOW' END AS condition, q.price AS quote
        FROM held h JOIN quotes q USING (symbol)) WHERE CASE WHEN condition = 'ABOVE' THEN quote >= level ELSE quote <= level END""",
        **P,
    ),
    "model_gates": sql(
        f"""SELECT horizon, n::BIGINT AS n, array_to_string(list_filter([CASE WHEN n < 20 THEN 'samples' END, CASE WHEN k < 2 THEN 'bins' END, CASE WHEN ece > 0.35 THEN 'ece' END], lambda x: x IS NOT NULL), ',') AS blocking FROM (
        SELECT horizon, {CALIBRATED} FROM (SELECT horizon, {BIN} AS bin, count(*) AS n, sum(prob) AS sp, sum(outcome) AS sy, sum(pow(prob - outcome, 2)) AS se FROM scored WHERE partition = 'VALIDATION' GROUP BY ALL) GROUP BY horizon)""",
        **S,
    ),
    "resolved_predictions": sql("SELECT symbol, horizon, count(*) AS n, round(avg(((prob >= 0.5) = (ret > 0))::INT), 6) AS correct FROM scored GROUP BY symbol, horizon", **S),
}
