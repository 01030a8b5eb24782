"""Reports on trades, calibration and gates, and lists of a portfolio's owner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import rounded
from barloom.operators import features, joins, labels, outcomes, portfolio, scoring
from barloom.plans.data_queries import REGIME, decimals
from barloom.plans.oracle import layered as nested
from barloom.plans.oracle import rounded as r
from barloom.plans.oracle import sql
from barloom.plans.outcome_queries import BIN, BINS8, BLOCKS, CALIBRATED, KNOTS, METRICS, S, T, scored, trades
from barloom.plans.score_queries import state
from barloom.sources import tables

ORDER = ["exit_bar", "symbol", "bar"]


def judged(spark, sf_dir) -> DataFrame:
    """Trades with the probability that was given to their own direction, and whether it was right."""
    own = F.when(F.col("side") == "LONG", F.col("prob")).otherwise(1 - F.col("prob"))
    return trades(spark, sf_dir).withColumns({"own": own, "right": (F.col("gross") > 0).cast("double")})


def days() -> Column:
    return F.greatest(F.lit(1.0), F.floor(F.col("n") / 4).cast("double"))


def regime_performance(spark, sf_dir):
    """Trades by the market's regime at their entry (one row per bar)."""
    bench = tables.benchmark(tables.bars(spark, sf_dir))
    regime = labels.market_regime(bench, tables.vix(bench)).select("bar", "regime")
    df = judged(spark, sf_dir).join(regime, "bar").groupBy("regime")
    return rounded(df.agg(F.count("*").alias("trades"), F.avg("right").alias("win_rate"), (F.avg("net") * 100).alias("avg_return")))


def partition_performance(spark, sf_dir):
    """Trades by walk-forward partition and horizon, with the partition's first and last bar."""
    keys = ["partition", "horizon"]
    t = judged(spark, sf_dir)
    bounds = scored(spark, sf_dir).groupBy("partition").agg(F.min("bar").alias("first"), F.max("bar").alias("last"))
    brier = t.groupBy(*keys).agg(F.avg(F.pow(F.col("own") - F.col("right"), 2)).alias("brier"))
    risk = outcomes.risk_metrics(t, keys, ORDER, days()).select(*keys, "cagr", "sharpe", "sortino", "max_drawdown")
    return rounded(outcomes.trade_metrics(t, keys).join(risk, keys).join(brier, keys).join(bounds, "partition"))


def overall_summary(spark, sf_dir):
    """All trades and each horizon's: rates, mean gain and loss, and how many losses a gain makes good."""
    won, lost = F.avg(F.when(F.col("net") > 0, F.col("net"))), F.abs(F.avg(F.when(F.col("net") <= 0, F.col("net"))))
    grouped, named = outcomes.sets_of(judged(spark, sf_dir), ["horizon"], [[]])
    sums = grouped.agg(
        F.grouping("horizon").alias("_over_horizon"), F.count("*").alias("trades"), (F.avg("right") * 100).alias("win_rate"), (F.avg("net") * 100).alias("avg_return"), F.coalesce(won, F.lit(0.0)).alias("avg_win"),
        F.coalesce(lost, F.lit(0.0)).alias("avg_loss"), F.avg(F.pow(F.col("own") - F.col("right"), 2)).alias("brier"),
    )
    sums = sums.select(*named, *[c for c in sums.columns if not c.endswith("horizon")])
    return rounded(sums.withColumn("reward_risk", F.coalesce(F.col("avg_win") / F.nullif("avg_loss", F.lit(0.0)), F.lit(0.0))))


def windows(spark, sf_dir) -> DataFrame:
    """Three windows: the bars of each partition but the last, cut after 70 percent into a part before and a tested one. One row per bar is ranked."""
    bars = scored(spark, sf_dir).where("partition <> 'HOLDOUT'").select("partition", "bar").distinct()
    own = Window.partitionBy("partition")
    cut = F.floor(F.count("*").over(own) * 0.7)
    placed = bars.withColumn("tested", F.row_number().over(own.orderBy("bar")) > cut)
    before, tested = F.when(~F.col("tested"), F.col("bar")), F.when(F.col("tested"), F.col("bar"))
    return placed.groupBy("partition").agg(F.min(before).alias("train_start"), F.max(before).alias("train_end"), F.min(tested).alias("test_start"), F.max(tested).alias("test_end"))


def rolling_windows(spark, sf_dir):
    """Five-bar trades of each tested part."""
    spans = windows(spark, sf_dir).withColumnRenamed("partition", "window")  # three rows
    t = judged(spark, sf_dir).where("horizon = '5d'").join(F.broadcast(spans), F.col("bar").between(F.col("test_start"), F.col("test_end")))
    risk = outcomes.risk_metrics(t, ["window"], ORDER, days()).select("window", "cagr", "sharpe", "sortino")
    right = outcomes.calibration_metrics(t.select("window", F.col("own").alias("prob"), F.col("right").alias("outcome")), ["window"]).select("window", "brier", "ece")
    rates = t.groupBy("window").agg(F.count("*").alias("trades"), (F.avg("right") * 100).alias("win_rate"))
    return rounded(spans.join(rates, "window").join(risk, "window").join(right, "window"))


def rolling_summary(spark, sf_dir):
    """How the windows differ: mean, median, deviation, worst and best of each measure."""
    of = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("x")) for m in ("sharpe", "win_rate", "cagr")])
    long = rolling_windows(spark, sf_dir).select(F.explode(of).alias("m")).select("m.*")
    return rounded(long.groupBy("measure").agg(F.avg("x").alias("mean"), F.median("x").alias("median"), F.stddev_samp("x").alias("std"), F.min("x").alias("worst"), F.max("x").alias("best")))


def calibration_gate(spark, sf_dir):
    """Calibrated test probabilities measured, and whether the knots never fall."""
    df = scored(spark, sf_dir)
    knots = outcomes.fit_binned_isotonic(df.where("partition = 'VALIDATION'"))
    tested = joins.calibrate(df.where("partition = 'TEST'"), knots).withColumn("prob", F.col("calibrated"))
    measured = outcomes.calibration_metrics(tested, ["horizon"]).select("horizon", "n", "brier", "ece", "mce", "populated_bins")
    return rounded(measured.join(knots_state(knots).select("horizon", "monotone"), "horizon"))


def knots_state(knots: DataFrame) -> DataFrame:
    """Number of knots by horizon, and 1 if none lies under the one before."""
    up = F.coalesce(F.lag("y").over(Window.partitionBy("horizon").orderBy("x")) <= F.col("y"), F.lit(True))
    return knots.withColumn("up", up.cast("int")).groupBy("horizon").agg(F.count("*").alias("knots"), F.min("up").alias("monotone"))


def release_gates(spark, sf_dir):
    """Why a horizon's scores may not be used: samples, bins, error, knots, falling knots or partitions out of order."""
    df = scored(spark, sf_dir)
    knots = knots_state(outcomes.fit_binned_isotonic(df.where("partition = 'VALIDATION'")))
    of = {p: F.col("partition") == p for p in ("TRAIN", "VALIDATION", "TEST", "HOLDOUT")}
    ends = df.groupBy("horizon").agg(
        *[f(F.when(of[p], F.col("bar"))).alias(f"{name}_{p}".lower()) for p in of for name, f in (("first", F.min), ("last", F.max))], F.count(F.when(of["TRAIN"], 1)).alias("trained")
    )
    ordered = (F.col("last_train") <= F.col("last_validation")) & (F.col("last_validation") <= F.col("last_test")) & (F.col("last_test") <= F.col("last_holdout"))
    ordered = ordered & (F.col("first_train") <= F.col("first_validation")) & (F.col("first_validation") <= F.col("first_test")) & (F.col("first_test") <= F.col("first_holdout"))
    m = outcomes.calibration_metrics(df.where("partition = 'VALIDATION'"), ["horizon"]).join(knots, "horizon").join(ends, "horizon")
    reasons = F.array(
        F.when(F.col("trained") < 40, "training"), F.when(F.col("n") < 20, "samples"), F.when(F.col("populated_bins") < 2, "bins"), F.when(F.col("ece") > 0.35, "ece"),
        F.when(F.col("knots") < 2, "knots"), F.when(F.col("monotone") == 0, "falling"), F.when(~F.coalesce(ordered, F.lit(False)), "dates"),
    )
    return m.select("horizon", "trained", "n", "knots", "monotone", F.array_join(F.filter(reasons, lambda x: x.isNotNull()), ",").alias("blocking"))


def calibrated_rank(spark, sf_dir):
    """Each bar's symbols by calibrated probability of 20 bars."""
    knots = outcomes.fit_binned_isotonic(scored(spark, sf_dir).where("partition = 'VALIDATION'"))
    df = scoring.score(state(spark, sf_dir)).select("bar", "symbol", F.lit("20d").alias("horizon"), F.col("prob_20d").alias("prob"))
    of = Window.partitionBy("bar")
    place = F.row_number().over(of.orderBy(F.desc("calibrated"), "symbol")).cast("long")
    ranked = joins.calibrate(df, knots).select("bar", "symbol", "calibrated", place.alias("rank"), F.count("*").over(of).alias("size"))
    return rounded(ranked.withColumn("percentile", F.round(100 - (F.col("rank") - 1) / F.col("size") * 100, 1)))


def warm_features(spark, sf_dir):
    panel = tables.bars(spark, sf_dir)
    df = features.warm(features.feature_panel(panel, tables.benchmark(panel)))
    return rounded(df.select("symbol", "bar", F.col("rn").cast("long").alias("rn"), "rsi_14", "sma_50_dist", "vol_60d"))


def trade_journal(spark, sf_dir):
    """Sells of symbols or names with a word in them, the highest value first."""
    df = portfolio.journal(tables.transactions(spark, sf_dir), tables.universe(spark, sf_dir), "brand#2", "SELL", "highest_value")
    return decimals(rounded(df.select("portfolio", "symbol", "name", "ts", "qty", "price", "value")))


def user_alerts(spark, sf_dir):
    """Each order's price as its owner's alert; those of small orders are off."""
    df = tables.transactions(spark, sf_dir).select(
        F.col("portfolio").alias("user"), "symbol", F.col("price").cast("double").alias("level"), F.when(F.col("side") == "SELL", "GREATER_THAN").otherwise("LESS_THAN").alias("condition"),
        F.col("ts").alias("created"), (F.col("qty") >= 10).alias("active"),
    )
    return rounded(portfolio.user_alerts(df))


QUERIES = {f.__name__: f for f in (
    regime_performance, partition_performance, overall_summary, rolling_windows, rolling_summary, calibration_gate, release_gates, calibrated_rank, warm_features, trade_journal, user_alerts,
)}

B = "symbol, bar::VARCHAR AS bar"
JUDGED = "SELECT *, CASE WHEN side = 'LONG' THEN prob ELSE 1 - prob END AS own, (gross > 0)::INT AS rgt FROM fills"
BRIER = "round(avg(pow(own - rgt, 2)), 6) AS brier"


def risk_of(key: str, source: str) -> str:
    """Growth, Sharpe and Sortino ratio and drawdown of the trades in ``source`` by ``key``."""
    w = f"PARTITION BY {key} ORDER BY exit_bar, symbol, bar ROWS UNBOUNDED PRECEDING"
    return f"""SELECT {key}, {r('cagr max_drawdown')}, round((mean * 252 - 0.065) / (std * sqrt(252)), 6) AS sharpe, round((mean * 252 - 0.065) / (down * sqrt(252)), 6) AS sortino FROM (
      SELECT *, pow(greatest(0.01, final / 100), 252 / greatest(1.0, floor(n / 4.0))) - 1 AS cagr FROM (
      SELECT {key}, count(*) AS n, 100 * exp(sum(ln(greatest(1e-9, 1 + 0.05 * net)))) AS final, avg(0.05 * net) AS mean, stddev_pop(0.05 * net) AS std,
        sqrt(sum(pow(0.05 * net, 2)) FILTER (net < 0) / count(*)) AS down, least(0, min(equity / top - 1)) AS max_drawdown FROM (
        SELECT *, greatest(100, max(equity) OVER ({w})) AS top FROM (SELECT *, 100 * exp(sum(ln(greatest(1e-9, 1 + 0.05 * net))) OVER ({w})) AS equity FROM {source})) GROUP BY {key}))"""


J = T | {"judged": JUDGED}
SPANS = """SELECT partition AS window_, min(bar) FILTER (NOT tested) AS train_start, max(bar) FILTER (NOT tested) AS train_end, min(bar) FILTER (tested) AS test_start, max(bar) FILTER (tested) AS test_end FROM (
  SELECT *, row_number() OVER (PARTITION BY partition ORDER BY bar) > floor(count(*) OVER (PARTITION BY partition) * 0.7) AS tested FROM (SELECT DISTINCT partition, bar FROM scored WHERE partition <> 'HOLDOUT')) GROUP BY partition"""
ROLLED = f"""SELECT s.window_ AS "window", train_start::VARCHAR AS train_start, train_end::VARCHAR AS train_end, test_start::VARCHAR AS test_start, test_end::VARCHAR AS test_end, trades, win_rate, cagr, sharpe, sortino, brier, ece
  FROM spans s JOIN (SELECT window_, count(*) AS trades, round(avg(rgt) * 100, 6) AS win_rate FROM late_trades GROUP BY 1) a USING (window_) JOIN ({risk_of('window_', 'late_trades')}) b USING (window_)
  JOIN (SELECT window_, {r('brier ece')} FROM (SELECT window_, {CALIBRATED} FROM (SELECT window_, least(7, floor(own * 8))::INT AS bin, count(*) AS n, sum(own) AS sp, sum(rgt) AS sy, sum(pow(own - rgt, 2)) AS se FROM late_trades GROUP BY ALL) GROUP BY ALL)) c USING (window_)"""
W = J | {"spans": SPANS, "late_trades": "SELECT j.*, window_ FROM judged j JOIN spans ON bar BETWEEN test_start AND test_end WHERE horizon = '5d'", "rolled": ROLLED}
K = S | {"bins8": BINS8, "blocks": BLOCKS, "knots": KNOTS}


def calibrated_sql(source: str) -> str:
    """``source`` (horizon, prob, ...) with ``calibrated`` by the knots."""
    return f"""SELECT s.*, CASE WHEN p <= min_x THEN min_y WHEN p >= max_x THEN max_y ELSE round(greatest(0.05, least(0.95, y0 + (p - x0) / (x1 - x0) * (y1 - y0)))::DECIMAL(24, 10), 4)::DOUBLE END AS calibrated FROM (
      SELECT *, greatest(0.01, least(0.99, prob)) AS p FROM {source}) s
      JOIN (SELECT horizon AS hz, min(x) AS min_x, max(x) AS max_x, arg_min(y, x) AS min_y, arg_max(y, x) AS max_y FROM knots GROUP BY 1) e ON e.hz = s.horizon
      LEFT JOIN (SELECT horizon AS h2, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM knots WINDOW w AS (PARTITION BY horizon ORDER BY x)) k ON h2 = s.horizon AND p >= x0 AND p < x1"""


STATE_OF_KNOTS = "SELECT horizon, count(*) AS knots, min(up)::INT AS monotone FROM (SELECT horizon, coalesce((lag(y) OVER (PARTITION BY horizon ORDER BY x) <= y)::INT, 1) AS up FROM knots) GROUP BY horizon"
PROB_20D = nested("state", [{c: e for c, e in layer.items() if c.startswith(("raw", "prob"))} for layer in scoring.SCORES[:2]])
ORACLE_SQL = {
    "regime_performance": sql("SELECT regime, count(*) AS trades, round(avg(rgt), 6) AS win_rate, round(avg(net) * 100, 6) AS avg_return FROM judged JOIN regime_of USING (bar) GROUP BY regime", **J, regime_of=REGIME),
    "partition_performance": sql(
        f"""SELECT m.*, cagr, sharpe, sortino, max_drawdown, brier, first, last FROM (SELECT partition, horizon, {METRICS} FROM fills GROUP BY partition, horizon) m
        JOIN ({risk_of('partition, horizon', 'fills')}) k USING (partition, horizon) JOIN (SELECT partition, horizon, {BRIER} FROM judged GROUP BY ALL) b USING (partition, horizon)
        JOIN (SELECT partition, min(bar)::VARCHAR AS first, max(bar)::VARCHAR AS last FROM scored GROUP BY partition) d USING (partition)""",
        **J,
    ),
    "overall_summary": sql(
        f"""SELECT *, round(coalesce(w / nullif(l, 0), 0), 6) AS reward_risk FROM (SELECT horizon, count(*) AS trades, round(avg(rgt) * 100, 6) AS win_rate, round(avg(net) * 100, 6) AS avg_return, {BRIER},
        coalesce(avg(net) FILTER (net > 0), 0) AS w, coalesce(abs(avg(net) FILTER (net <= 0)), 0) AS l FROM (SELECT * FROM judged UNION ALL SELECT * REPLACE ('ALL' AS horizon) FROM judged) GROUP BY horizon)""".replace("SELECT *, round(coalesce", "SELECT * EXCLUDE (w, l), round(w, 6) AS avg_win, round(l, 6) AS avg_loss, round(coalesce"),
        **J,
    ),
    "rolling_windows": sql("SELECT * FROM rolled", **W),
    "rolling_summary": sql(
        "SELECT measure, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(stddev_samp(x), 6) AS std, min(x) AS worst, max(x) AS best FROM ("
        + " UNION ALL ".join(f"SELECT '{m}' AS measure, {m} AS x FROM rolled" for m in ("sharpe", "win_rate", "cagr"))
        + ") GROUP BY measure",
        **W,
    ),
    "calibration_gate": sql(
        f"""SELECT horizon, n::BIGINT AS n, {r('brier ece mce')}, k AS populated_bins, monotone FROM (SELECT horizon, {CALIBRATED} FROM (
        SELECT horizon, {BIN.replace('prob', 'calibrated')} AS bin, count(*) AS n, sum(calibrated) AS sp, sum(outcome) AS sy, sum(pow(calibrated - outcome, 2)) AS se FROM ({calibrated_sql("(SELECT * FROM scored WHERE partition = 'TEST')")}) GROUP BY ALL) GROUP BY horizon)
        JOIN kstate USING (horizon)""",
        **K, kstate=STATE_OF_KNOTS,
    ),
    "release_gates": sql(
        f"""SELECT horizon, trained, n::BIGINT AS n, knots, monotone, array_to_string(list_filter([CASE WHEN trained < 40 THEN 'training' END, CASE WHEN n < 20 THEN 'samples' END, CASE WHEN k < 2 THEN 'bins' END,
        CASE WHEN ece > 0.35 THEN 'ece' END, CASE WHEN knots < 2 THEN 'knots' END, CASE WHEN monotone = 0 THEN 'falling' END, CASE WHEN NOT coalesce(ordered, false) THEN 'dates' END], lambda x: x IS NOT NULL), ',') AS blocking FROM (
        SELECT horizon, {CALIBRATED} FROM (SELECT horizon, {BIN} AS bin, count(*) AS n, sum(prob) AS sp, sum(outcome) AS sy, sum(pow(prob - outcome, 2)) AS se FROM scored WHERE partition = 'VALIDATION' GROUP BY ALL) GROUP BY horizon)
        JOIN kstate USING (horizon) JOIN (SELECT horizon, count(*) FILTER (partition = 'TRAIN') AS trained, l[1] <= l[2] AND l[2] <= l[3] AND l[3] <= l[4] AND f[1] <= f[2] AND f[2] <= f[3] AND f[3] <= f[4] AS ordered FROM (
          SELECT horizon, partition, [{', '.join(f"max(bar) FILTER (partition = '{p}') OVER w" for p in ('TRAIN', 'VALIDATION', 'TEST', 'HOLDOUT'))}] AS l, [{', '.join(f"min(bar) FILTER (partition = '{p}') OVER w" for p in ('TRAIN', 'VALIDATION', 'TEST', 'HOLDOUT'))}] AS f
          FROM scored WINDOW w AS (PARTITION BY horizon)) GROUP BY horizon, ordered) USING (horizon)""",
        **K, kstate=STATE_OF_KNOTS,
    ),
    "calibrated_rank": sql(
        f"""SELECT bar::VARCHAR AS bar, symbol, calibrated, rank, size, round(100 - (rank - 1) / size * 100, 1) AS percentile FROM (
        SELECT *, row_number() OVER (PARTITION BY bar ORDER BY calibrated DESC, symbol) AS rank, count(*) OVER (PARTITION BY bar) AS size FROM ({calibrated_sql("asked")}))""",
        **K, asked=f"SELECT bar, symbol, '20d' AS horizon, prob_20d AS prob FROM ({PROB_20D})",
    ),
    "warm_features": sql(f"SELECT {B}, rn, {r('rsi_14 sma_50_dist vol_60d')} FROM panel WHERE rn >= 49"),
    "trade_journal": sql(
        """SELECT portfolio, symbol, name, ts::VARCHAR AS ts, qty, price::DOUBLE AS price, (qty * price)::DOUBLE AS value FROM ledger JOIN universe USING (symbol)
        WHERE side = 'SELL' AND (contains(lower(symbol), 'brand#2') OR contains(lower(name), 'brand#2'))"""
    ),
    "user_alerts": sql(
        """SELECT portfolio AS "user", symbol, price::DOUBLE AS level, CASE WHEN side = 'SELL' THEN 'ABOVE' ELSE 'BELOW' END AS condition, ts::VARCHAR AS created,
        row_number() OVER (PARTITION BY portfolio ORDER BY ts DESC, symbol, price) AS place FROM ledger WHERE qty >= 10"""
    ),
}
