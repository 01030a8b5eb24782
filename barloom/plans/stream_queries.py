"""Queries that drain a stream over the tables, and stored-table and model queries."""

from __future__ import annotations

import uuid
from functools import partial, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import rounded
from barloom.operators import digests, features, labels, models, scoring
from barloom.operators.features import feature_panel
from barloom.plans.data_queries import NAMED, named
from barloom.plans.news_sql import NEWS
from barloom.plans.oracle import layered as nested
from barloom.plans.oracle import rounded as r
from barloom.plans.oracle import sql
from barloom.plans.outcome_queries import S, SCORES_ONLY, scored
from barloom.sources import files, tables, versioned
from barloom.sources.quotes import quote_stream
from barloom.sources.shared import shared_path
from barloom.streaming import streams


def quotes(spark, sf_dir):
    return streams.ticks(streams.stream_table(spark, f"{sf_dir}/events.parquet"))


def levels(spark, sf_dir):
    """Brackets from the ticks' own spread: one row per symbol."""
    q = F.percentile("px", F.array(F.lit(0.02), F.lit(0.98)))
    return tables.ticks(spark, sf_dir).groupBy("symbol").agg(q.alias("q")).select("symbol", F.get("q", F.lit(0)).alias("stop"), F.get("q", F.lit(1)).alias("target"))


def polls(spark, sf_dir):
    """Events as landed quotes: all that has landed is one poll. Symbols are a bounded list."""
    path = f"{sf_dir}/events.parquet"
    symbols = [r[0] for r in spark.read.parquet(path).select("event_type").where("event_type IS NOT NULL").distinct().collect()]
    return quote_stream(spark, path, symbols, "event_type,ts,value,event_id")


def stream_latest_quote(spark, sf_dir):
    return rounded(streams.drained(streams.latest_quotes(polls(spark, sf_dir)), "latest", "complete"))


def stream_bars(spark, sf_dir):
    return rounded(streams.drained(streams.stream_bars(quotes(spark, sf_dir)), "bars"))


def polled_bars(spark, sf_dir):
    """The same bars from landed quotes that are polled."""
    return rounded(streams.drained(streams.stream_bars(polls(spark, sf_dir)), "polled-bars", polled=True))


def stream_activity(spark, sf_dir):
    return rounded(streams.drained(streams.stream_activity(quotes(spark, sf_dir)), "activity"))


def stream_exits(spark, sf_dir):
    held = levels(spark, sf_dir).withColumn("portfolio", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))))
    return rounded(streams.drained(streams.exits(quotes(spark, sf_dir), held, 3_600_000), "exits"))


def stream_alerts(spark, sf_dir):
    of = levels(spark, sf_dir).select(F.conv(F.substring(F.md5("symbol"), 1, 8), 16, 10).cast("long").alias("alert"), "symbol", F.col("target").alias("level"), F.lit("ABOVE").alias("condition"))
    return rounded(streams.drained(streams.alerts(quotes(spark, sf_dir), of), "alerts"))


def stream_headlines(spark, sf_dir):
    docs = streams.stream_table(spark, f"{sf_dir}/documents.parquet")
    lines = docs.select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("title"),
        "source",
        F.concat(F.lit("https://news.example/"), F.col("source"), F.lit("/"), F.sha2("text", 256)).alias("url"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"),
    )
    return streams.drained(streams.stream_headlines(lines), "headlines").select("url", "category", "sentiment", "impact")


#: Portfolios of a share of the ledger's state, about.
PORTFOLIOS = 128


def stream_ledger(spark, sf_dir):
    """The ledger replayed from a stream of line items, joined to the tables of orders and parts."""
    lines = streams.stream_table(spark, f"{sf_dir}/lineitem.parquet")
    orders = tables.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("portfolio"))
    parts = tables.table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    rows = joined.select(
        "portfolio",
        "symbol",
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
        F.col("l_quantity").cast("long").alias("qty"),
        (F.col("l_extendedprice") / F.col("l_quantity")).cast("decimal(18,4)").cast("decimal(14,2)").cast("double").alias("price"),
        F.to_json(F.struct(*tables.SEQ)).alias("seq_key"),
    )
    portfolios = orders.agg(F.approx_count_distinct("portfolio")).first()[0]
    # line items land in no order of time, so none is late; a batch holds orders of nearly all portfolios
    return rounded(streams.latest_standing(streams.drained(streams.ledger(rows, late="3650 days", shares=1 + portfolios // PORTFOLIOS), "ledger")))


def scan_bars(spark, sf_dir):
    """Bars written by year, appended to and read back."""
    panel, path = tables.bars(spark, sf_dir), shared_path(spark, "stored-bars")
    files.write_bars(panel.where("bar < DATE '2001-01-01'"), path)
    files.append_bars(panel, path)
    return rounded(files.scan_bars(spark, path, 340, ["Brand#1"]).select("symbol", "bar", "open", "high", "low", "close", "volume"))


def fit_logistic(spark, sf_dir):
    return models.logistic_weights(models.training_frame(spark, sf_dir))


def samples(spark, sf_dir):
    """Bars of the training partition with whether their price rose over five bars."""
    panel = tables.bars(spark, sf_dir)
    parted = labels.by_progress(labels.forward_labels(feature_panel(panel, tables.benchmark(panel))), step=1)
    return models.trade_samples(parted, models.LINEAR)


def training_samples(spark, sf_dir):
    return rounded(samples(spark, sf_dir))


def sample_statistics(spark, sf_dir):
    """Count, mean and deviation of each input over the training samples."""
    return rounded(models.sample_statistics(samples(spark, sf_dir), models.LINEAR))


def learned_weights(spark, sf_dir):
    """The learned linear score's table, fitted for each horizon on the training partition."""
    panel = tables.bars(spark, sf_dir)
    parted = labels.by_progress(labels.forward_labels(feature_panel(panel, tables.benchmark(panel))), step=1)
    parted = models.staged(parted.select("symbol", "bar", "partition", *models.LINEAR, *[f"gross_{h}" for h in ("1d", "5d", "20d")]))

    def fit(h):
        made = models.fit_linear(models.trade_samples(parted, models.LINEAR, f"gross_{h}"), models.LINEAR)
        return None if made is None else made.withColumn("horizon", F.lit(h))

    done = [x for x in models.at_once(spark, [partial(fit, h) for h in ("1d", "5d", "20d")]) if x is not None]
    return rounded(reduce(DataFrame.unionByName, done)) if done else spark.createDataFrame([], "input string, mean double, std double, weight double, horizon string")


#: What unknown inputs become: the middle of an oscillator, no return, no distance.
NEUTRAL = {"rsi_14_wilder": 50.0, "stoch_d": 50.0, "momentum_10": 0.0, "close_zscore": 0.0}


def clamped_inputs(spark, sf_dir):
    """Inputs and a tilt of one half by the z-score, cleaned for a model."""
    panel = tables.bars(spark, sf_dir)
    df = features.extra_features(panel, tables.benchmark(panel)).withColumn("prob", 0.5 + 0.3 * F.col("close_zscore"))
    return rounded(models.clean_inputs(df, NEUTRAL, ("prob",)).select("symbol", "bar", *NEUTRAL, "prob"))


def walk_forward(spark, sf_dir):
    """Test metrics by horizon and fold."""
    panel, out = tables.bars(spark, sf_dir), []
    for h in ("1d", "5d", "20d"):
        made = models.fold_predictions(models.training_frame(spark, sf_dir, h), panel)
        out += [models.walk_forward(made).withColumn("horizon", F.lit(h))] if made is not None else []
    return reduce(DataFrame.unionByName, out)


def final_fit_holdout(spark, sf_dir):
    """Holdout metrics by horizon of models fitted on everything before."""
    panel = tables.bars(spark, sf_dir)
    parts = [models.final_fit_holdout(models.training_frame(spark, sf_dir, h), panel)[1].withColumn("horizon", F.lit(h)) for h in ("1d", "5d", "20d")]
    return rounded(reduce(DataFrame.unionByName, parts))


def score_logistic(spark, sf_dir):
    """Bars' linear scores by weights from all labelled bars."""
    panel = tables.bars(spark, sf_dir)
    df = feature_panel(panel, tables.benchmark(panel))
    weights = models.linear_weights(labels.forward_labels(df).withColumn("label", F.col("target_5d")).where("label IS NOT NULL"))
    return rounded(models.score_logistic(df, weights).select("symbol", "bar", "prob"))


def feed(docs):
    """Documents as a feed of headlines, a quarter of an hour apart."""
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") * 900)
    url = F.concat(F.lit("https://news.example/"), F.col("source"), F.lit("/"), F.col("doc_id"))
    return docs.select(F.col("doc_id").alias("id"), F.col("text").alias("title"), "source", url.alias("url"), at.alias("ts"))


def stream_sentiment(spark, sf_dir):
    docs = streams.stream_table(spark, f"{sf_dir}/documents.parquet")
    return rounded(streams.drained(streams.stream_sentiment(feed(docs), named(tables.universe(spark, sf_dir))), "sentiment"))


def stored_predictions(spark, sf_dir):
    """All predictions, written by year, read back and resolved."""
    panel = tables.bars(spark, sf_dir)
    df = scoring.score(feature_panel(panel, tables.benchmark(panel)).withColumns({"news_sentiment": F.lit(None).cast("double"), "atr_14": F.lit(None).cast("double")}))
    long = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"prob_{h}").alias("prob")) for h in labels.HORIZONS])
    path = shared_path(spark, "stored-predictions")
    files.write_predictions(df.select("symbol", "bar", F.explode(long).alias("x")).select("symbol", "bar", "x.*"), path)
    return rounded(files.resolve_predictions(spark.read.parquet(path), panel, labels.HORIZONS))


def incremental_predictions(spark, sf_dir):
    """Predictions recorded and resolved in two runs, at a bar of 1996 and at the end: the second run only writes years that it adds to or that were open."""
    panel = tables.bars(spark, sf_dir)
    df = scoring.score(feature_panel(panel, tables.benchmark(panel)).withColumns({"news_sentiment": F.lit(None).cast("double"), "atr_14": F.lit(None).cast("double")}))
    long = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"prob_{h}").alias("prob")) for h in labels.HORIZONS])
    made = df.select("symbol", "bar", F.explode(long).alias("x")).select("symbol", "bar", "x.*")
    path, known = shared_path(spark, "predictions"), F.col("bar") < F.lit("1996-07-01").cast("date")
    for run in (known, ~known):
        files.record_predictions(made.where(run), path)
        files.resolve_open(panel.where(known) if run is known else panel, path, labels.HORIZONS)
    return rounded(versioned.scan(spark, path, files.PREDICTIONS))


def bucketed_features(spark, sf_dir):
    """The feature panel over bars that are stored bucketed by symbol."""
    name = f"bars_{uuid.uuid4().hex}"
    panel = files.write_bucketed(tables.bars(spark, sf_dir), name, shared_path(spark, "bucketed-bars"))
    bench = shared_path(spark, "benchmark")  # a row per bar: stored, so that its size is known and Spark can send it to the buckets
    tables.benchmark(panel).write.parquet(bench)
    return rounded(feature_panel(panel, spark.read.parquet(bench)).withColumn("rn", F.col("rn").cast("long")))


def bar_texts():
    """A bar's values as text, at six decimals."""
    return [F.floor(F.col(c) * 1_000_000 + 0.5) for c in ("open", "high", "low", "close", "volume")]


def table_digest(spark, sf_dir):
    """Digests of all bars, of each year, and of each symbol's year."""
    panel = tables.bars(spark, sf_dir).withColumn("year", F.year("bar"))
    return digests.tree(panel, ["year", "symbol"], [F.col("symbol"), F.col("bar"), *bar_texts()])


def changed_partitions(spark, sf_dir):
    """Symbols' years that two stored trees tell apart: in the second one a close of each symbol's last bar of 1995 is a tenth higher, and 1997 lacks a symbol."""
    panel = tables.bars(spark, sf_dir).withColumn("year", F.year("bar"))
    last = F.max("bar").over(Window.partitionBy("symbol", "year"))
    other = panel.withColumn("close", F.when((F.col("year") == 1995) & (F.col("symbol") < "Brand#3") & (F.col("bar") == last), F.col("close") * 1.1).otherwise(F.col("close")))
    other = other.where("NOT (year = 1997 AND symbol = 'Brand#12')")
    stored = []
    for k, df in enumerate((panel, other)):
        path = shared_path(spark, f"digest-{k}")
        digests.tree(df, ["year", "symbol"], [F.col("symbol"), F.col("bar"), *bar_texts()]).write.parquet(path)
        stored.append(spark.read.parquet(path))
    return digests.changed(*stored, ["year", "symbol"])


def fit_isotonic(spark, sf_dir):
    return models.isotonic_knots(scored(spark, sf_dir).where("partition = 'VALIDATION'"))


QUERIES = {f.__name__: f for f in (
    stream_latest_quote, stream_bars, polled_bars, stream_activity, stream_exits, stream_alerts, stream_headlines, stream_ledger, scan_bars, fit_logistic, walk_forward, fit_isotonic,
    final_fit_holdout, score_logistic, stream_sentiment, stored_predictions, incremental_predictions, bucketed_features, table_digest, changed_partitions,
    training_samples, sample_statistics, learned_weights, clamped_inputs,
)}

LAST = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM ticks)"
#: The greedy choice of exits, hit by hit; hits that the watermark hasn't passed at the end are open.
EXITS = {
    "brackets": "SELECT symbol, quantile_cont(px, 0.02) AS stop, quantile_cont(px, 0.98) AS target FROM ticks GROUP BY symbol",
    "hits": """SELECT symbol, ts, px, CASE WHEN px <= stop THEN 'STOP' ELSE 'TARGET' END AS reason, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS k
      FROM ticks JOIN brackets USING (symbol) WHERE (px <= stop OR px >= target) AND epoch_us(ts) <= 1000 * (SELECT max(epoch_ms(ts)) - 600000 FROM ticks)""",
    "walk": """SELECT symbol, k, ms AS last, true AS fired FROM hits WHERE k = 1 UNION ALL
      SELECT h.symbol, h.k, CASE WHEN h.ms - w.last > 3600000 THEN h.ms ELSE w.last END, h.ms - w.last > 3600000 FROM walk w JOIN hits h ON h.symbol = w.symbol AND h.k = w.k + 1""",
}
#: A portfolio's orders one after the other: cash, holdings and counts after each. Cents are rounded as they are printed, from the exact double.
TWO = "printf('%.2f', {})::DOUBLE"
REPLAY = {
    "turns": """SELECT o_custkey AS portfolio, p_brand AS symbol, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, l_quantity::BIGINT AS qty,
      (l_extendedprice / l_quantity)::DECIMAL(18,4)::DECIMAL(14,2)::DOUBLE AS price,
      row_number() OVER (PARTITION BY o_custkey ORDER BY l_shipdate, l_orderkey || ',"l_linenumber":' || l_linenumber || ',"l_partkey":' || l_partkey || ',') AS k
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "folds": f"""SELECT DISTINCT portfolio, 0::BIGINT AS k, 1000000.0::DOUBLE AS cash, CAST([] AS STRUCT(s VARCHAR, q BIGINT, a DOUBLE)[]) AS held, 0::BIGINT AS accepted, 0::BIGINT AS rejected FROM turns UNION ALL
      SELECT portfolio, k, CASE WHEN NOT ok THEN cash WHEN side = 'BUY' THEN {TWO.format('cash - value')} ELSE {TWO.format('cash + value')} END,
        CASE WHEN ok THEN list_concat(rest, CASE WHEN side = 'BUY' THEN [{{'s': symbol, 'q': have + qty, 'a': {TWO.format('(have * average + value) / (have + qty)')}}}]
          WHEN have > qty THEN [{{'s': symbol, 'q': have - qty, 'a': average}}] ELSE [] END) ELSE held END, accepted + ok::INT, rejected + (NOT ok)::INT FROM (
      SELECT *, qty > 0 AND CASE WHEN side = 'BUY' THEN value <= cash ELSE qty <= have END AS ok FROM (
      SELECT *, coalesce(own.q, 0) AS have, coalesce(own.a, 0.0) AS average FROM (
      SELECT t.*, f.cash, f.held, f.accepted, f.rejected, {TWO.format('t.qty * t.price')} AS value, list_filter(f.held, lambda x: x.s = t.symbol)[1] AS own, list_filter(f.held, lambda x: x.s <> t.symbol) AS rest
      FROM folds f JOIN turns t ON t.portfolio = f.portfolio AND t.k = f.k + 1)))""",
    "ended": "SELECT portfolio, arg_max(cash, k) AS cash, arg_max(held, k) AS held, arg_max(accepted, k) AS accepted, arg_max(rejected, k) AS rejected FROM folds GROUP BY portfolio",
}
SAMPLED = {"sampled": "SELECT *, (g5 > 0)::INT::DOUBLE AS outcome FROM parted WHERE partition = 'TRAIN' AND g5 IS NOT NULL", "parted": S["parted"], "plain_state": S["plain_state"]}


def _field(e: str) -> str:
    return f"strlen({e}) || ':' || {e}"


DIGESTED = (
    "SELECT year(bar) AS year, symbol, ('0x' || substr(sha256("
    + " || ".join(_field(e) for e in ["symbol", "bar::VARCHAR", *[f"floor({c} * 1000000 + 0.5)::BIGINT::VARCHAR" for c in ("open", "high", "low", "close", "volume")]])
    + "), 1, 15))::BIGINT AS d FROM bars"
)
ORACLE_SQL = {
    "stream_latest_quote": sql("SELECT symbol, max(ts)::VARCHAR AS ts, round(arg_max(px, row(ts, seq)), 6) AS px FROM ticks GROUP BY symbol"),
    "stream_bars": sql(
        f"SELECT symbol, bar::VARCHAR AS bar, {r('open high low close')}, ticks FROM (SELECT symbol, time_bucket(INTERVAL 1 HOUR, ts) AS bar, arg_min(px, row(ts, seq)) AS open, max(px) AS high, min(px) AS low, "
        f"arg_max(px, row(ts, seq)) AS close, count(*) AS ticks FROM ticks GROUP BY ALL) WHERE bar + INTERVAL 1 HOUR <= {LAST}"
    ),
    "stream_activity": sql(
        f"SELECT symbol, start::VARCHAR AS start, count(*) AS n, round(sum(px), 6) AS total FROM (SELECT symbol, px, time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS start FROM ticks, range(4) t(k)) "
        f"WHERE start + INTERVAL 24 HOUR <= {LAST} GROUP BY ALL"
    ),
    "stream_alerts": sql(
        "SELECT ('0x' || substr(md5(symbol), 1, 8))::BIGINT AS alert, min(ts)::VARCHAR AS ts, round(arg_min(px, row(ts, seq)), 6) AS px FROM ticks JOIN tops USING (symbol) WHERE px >= target GROUP BY symbol",
        tops="SELECT symbol, quantile_cont(px, 0.98) AS target FROM ticks GROUP BY symbol",
    ),
    "stream_exits": sql("SELECT p AS portfolio, symbol, ts::VARCHAR AS ts, round(px, 6) AS px, reason FROM walk JOIN hits USING (symbol, k), (VALUES (1::BIGINT), (2::BIGINT)) v(p) WHERE fired", **EXITS),
    "stream_ledger": sql("SELECT portfolio, round(cash, 6) + 0.0 AS cash, len(held)::BIGINT AS positions, accepted, rejected FROM ended", **REPLAY),
    "ledger_replay": sql(
        """SELECT portfolio, symbol, qty, average, cash, accepted, rejected FROM (
        SELECT portfolio, h.s AS symbol, h.q AS qty, h.a AS average, cash, accepted, rejected FROM (SELECT *, unnest(held) AS h FROM ended)
        UNION ALL SELECT portfolio, NULL, 0, 0.0, cash, accepted, rejected FROM ended WHERE len(held) = 0)""",
        **REPLAY,
    ),
    "stream_headlines": sql("SELECT DISTINCT url, category, sentiment, impact FROM news", news=NEWS, headlines="SELECT doc_id AS id, text AS title, source, 'https://news.example/' || source || '/' || sha256(text) AS url FROM documents"),
    "stream_sentiment": sql(
        """SELECT symbol, start::VARCHAR AS start, score, news, CASE WHEN score >= 4 THEN 'BULLISH' WHEN score <= -4 THEN 'BEARISH' ELSE 'NEUTRAL' END AS label FROM (
        SELECT symbol, start, greatest(-20, least(20, sum(points)))::BIGINT AS score, count(*) AS news FROM (SELECT symbol, points, time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS start FROM met, range(4) t(k))
        WHERE start + INTERVAL 24 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM fed) GROUP BY ALL)""",
        fed="SELECT doc_id AS id, TIMESTAMP '2024-01-01' + doc_id * INTERVAL 15 MINUTE AS ts FROM documents",
        met="""SELECT symbol, ts, CASE WHEN direct THEN CASE impact WHEN 'HIGH' THEN 8 WHEN 'MEDIUM' THEN 5 ELSE 3 END ELSE CASE WHEN impact = 'HIGH' THEN 3 ELSE 2 END END
          * CASE sentiment WHEN 'POSITIVE' THEN 1 WHEN 'NEGATIVE' THEN -1 ELSE 0 END AS points FROM (
          SELECT u.symbol, n.*, f.ts, contains(n.t, lower(u.symbol)) OR contains(n.t, string_split(u.name, ' ')[1]) AS direct FROM news n JOIN fed f USING (id) JOIN named u
          ON contains(n.t, lower(u.symbol)) OR (length(string_split(u.name, ' ')[1]) >= 4 AND contains(n.t, string_split(u.name, ' ')[1])) OR contains(n.t, lower(u.sector)))""",
        news=NEWS, named=NAMED,
    ),
    "score_logistic": sql(
        "SELECT symbol, bar::VARCHAR AS bar, round(greatest(0.05, least(0.95, 1 / (1 + exp(-greatest(-10, least(10, z))))))::DECIMAL(20, 10), 4)::DOUBLE AS prob FROM (SELECT symbol, bar, "
        + " + ".join(f"({c} - m_{c}) / s_{c} * w_{c}" for c in sorted(models.LINEAR))
        + " AS z FROM panel, weights)",
        labelled="SELECT *, (lead(close, 5) OVER (PARTITION BY symbol ORDER BY bar) / close - 1 - " + repr(labels.round_trip_cost()) + " > 0)::INT::DOUBLE AS label FROM panel",
        weights="SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}, corr({c}, label) AS w_{c}" for c in models.LINEAR) + " FROM labelled WHERE label IS NOT NULL",
    ),
    "stored_predictions": sql(
        "SELECT symbol, bar::VARCHAR AS bar, horizon, prob + 0.0 AS prob, round(ret, 6) + 0.0 AS actual_return, then_::VARCHAR AS resolved_at, ((prob >= 0.5) = (ret > 0))::INT AS correct FROM ("
        + " UNION ALL ".join(f"SELECT symbol, bar, '{h}' AS horizon, prob_{h} AS prob, lead(close, {n}) OVER ws / close - 1 AS ret, lead(bar, {n}) OVER ws AS then_ FROM all_scored WINDOW ws AS (PARTITION BY symbol ORDER BY bar)" for h, n in labels.HORIZONS.items())
        + ")",
        plain_state=S["plain_state"], all_scored=nested("plain_state", SCORES_ONLY),
    ),
    "bucketed_features": sql(f"SELECT symbol, bar::VARCHAR AS bar, {r('open high low close volume')}, rn, {r(' '.join(features.DEFAULTS))} FROM panel"),
    "table_digest": sql(
        """SELECT CASE WHEN year IS NULL THEN 0 WHEN symbol IS NULL THEN 1 ELSE 2 END AS depth, year, symbol, count(*) AS n, (sum(d::HUGEINT) % 1152921504606846976)::BIGINT AS digest FROM digested GROUP BY ROLLUP (year, symbol)""",
        digested=DIGESTED,
    ),
    "training_samples": sql(f"SELECT symbol, bar::VARCHAR AS bar, {r(' '.join(models.LINEAR))}, outcome FROM sampled", **SAMPLED),
    "sample_statistics": sql(
        " UNION ALL ".join(f"SELECT '{c}' AS input, count({c}) AS n, round(coalesce(avg({c}), 0), 6) + 0.0 AS mean, round(coalesce(nullif(stddev_pop({c}), 0), 1), 6) + 0.0 AS std FROM sampled" for c in models.LINEAR), **SAMPLED
    ),
    "clamped_inputs": sql(
        f"SELECT symbol, bar::VARCHAR AS bar, {', '.join(f'round(coalesce({c}, {x}), 6) + 0.0 AS {c}' for c, x in NEUTRAL.items())}, round(greatest(0.05, least(0.95, coalesce(0.5 + 0.3 * close_zscore, 0.5))), 6) + 0.0 AS prob FROM extra"
    ),
    "changed_partitions": sql(
        """SELECT year, symbol, count(*) AS n_one, CASE WHEN year = 1997 THEN NULL ELSE count(*) END AS n_other FROM (SELECT year(bar) AS year, symbol FROM bars)
        WHERE (year = 1995 AND symbol < 'Brand#3') OR (year = 1997 AND symbol = 'Brand#12') GROUP BY year, symbol"""
    ),
    "scan_bars": sql(f"SELECT symbol, bar::VARCHAR AS bar, {r('open high low close volume')} FROM bars WHERE symbol <> 'Brand#1' QUALIFY count(*) OVER (PARTITION BY symbol) >= 340"),
}
ORACLE_SQL["incremental_predictions"] = ORACLE_SQL["stored_predictions"]
ORACLE_SQL["polled_bars"] = ORACLE_SQL["stream_bars"]
