"""Queries on raw candles, quotes, labels, folds and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.columns import rounded
from barloom.operators import cleaning, joins, labels
from barloom.operators.features import DEFAULTS, align_benchmark
from barloom.plans.oracle import rounded as r
from barloom.plans.oracle import sql
from barloom.sources import tables

PX4 = "open high low close"


def raw_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candle per trade and day as text, with some that aren't numbers and some with high under low."""
    px = F.col("px").cast("decimal(18,4)").cast("string")
    return tables.trades(spark, sf_dir).select(
        "symbol",
        F.col("l_shipdate").cast("date").alias("time"),
        px.alias("open"),
        F.when(F.col("qty") == 1, "0.5").otherwise(px).alias("high"),
        px.alias("low"),
        F.when(F.col("seq.l_linenumber") == 7, "n/a").otherwise(px).alias("close"),
        F.col("qty").cast("string").alias("volume"),
        "seq",
    )


RAW = """SELECT symbol, l_shipdate::DATE AS time, (px::DECIMAL(18,4))::VARCHAR AS open,
  CASE WHEN qty = 1 THEN '0.5' ELSE (px::DECIMAL(18,4))::VARCHAR END AS high, (px::DECIMAL(18,4))::VARCHAR AS low,
  CASE WHEN l_linenumber = 7 THEN 'n/a' ELSE (px::DECIMAL(18,4))::VARCHAR END AS close, qty::VARCHAR AS volume, seq
  FROM (SELECT *, struct_extract_at(seq, 3) AS l_linenumber FROM trades)"""
NUMBERS = f"SELECT symbol, time, seq, {', '.join(f'try_cast({c} AS DOUBLE) AS {c}' for c in (*PX4.split(), 'volume'))} FROM raw"


def clean_candles(spark, sf_dir):
    return rounded(cleaning.clean_candles(raw_candles(spark, sf_dir), ["symbol", "time"], "seq"))


def ohlc_anomalies(spark, sf_dir):
    return cleaning.ohlc_anomalies(cleaning.coerce_numeric(raw_candles(spark, sf_dir), [*PX4.split(), "volume"]), "time")


def resample_ticks(spark, sf_dir):
    ticks = tables.ticks(spark, sf_dir).withColumn("bar", F.window("ts", "15 minutes")["start"])
    return rounded(tables.to_bars(ticks, ["symbol", "bar"], "px", "qty", "seq"))


def resample_monthly(spark, sf_dir):
    return rounded(tables.to_bars(tables.trades(spark, sf_dir).withColumn("bar", F.to_date(F.date_trunc("month", "l_shipdate"))), ["symbol", "bar"], "px", "qty", "seq"))


def normalize_quotes(spark, sf_dir):
    quotes = tables.quotes(tables.bars(spark, sf_dir)).withColumn("ts", F.col("bar").cast("timestamp") + F.make_dt_interval(hours=F.lit(4)))
    return rounded(cleaning.normalize_quotes(quotes, cleaning.session_status(F.col("ts"))))


def session_status(spark, sf_dir):
    return tables.ticks(spark, sf_dir).select("symbol", "seq", cleaning.session_status(F.col("ts")).alias("status"))


SESSION = """CASE WHEN dayofweek({t}) IN (0, 6) THEN 'CLOSED' WHEN hour({t}) * 60 + minute({t}) BETWEEN 540 AND 554 THEN 'PRE_OPEN'
  WHEN hour({t}) * 60 + minute({t}) BETWEEN 555 AND 930 THEN 'OPEN' ELSE 'CLOSED' END"""
CENTS = "round(({})::DECIMAL(20,6), 2)::DOUBLE"


def min_history(spark, sf_dir):
    panel = tables.bars(spark, sf_dir)
    index = tables.universe(spark, sf_dir).where("tier = 'SMALL'")  # stands for the index symbols
    return rounded(cleaning.exclude_symbols(cleaning.min_history(panel, 340), index))


def upsert_dimension(spark, sf_dir):
    universe = tables.universe(spark, sf_dir)
    # each part brings its brand, which is known, and its brand with its size, which is new
    parts = tables.table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol"), F.col("p_name").alias("name"), F.col("p_type").alias("sector"), "p_partkey", "p_size")
    source = parts.unionByName(parts.withColumn("symbol", F.concat_ws("/", "symbol", "p_size"))).drop("p_size")
    return cleaning.upsert_dimension(universe.select("symbol", "name", "sector"), source, "symbol", "p_partkey")


def feed_items(spark, sf_dir):
    pages = tables.table(spark, sf_dir, "pages")
    return cleaning.feed_items(pages, "page_id", "html", r"(?s)(<a .*?</a>)", r"(?s)>(.*?)</a>", r'href="([^"]*)"')


def event_props(spark, sf_dir):
    """Nested fields of a JSON column, by an explicit schema."""
    props = tables.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k INT").alias("p"), "props")
    return props.select("event_id", F.col("p.k").alias("k"), F.length(F.to_json("p")).cast("long").alias("size"))


def net_labels(spark, sf_dir):
    df = labels.by_cost_regime(labels.forward_labels(tables.bars(spark, sf_dir)))
    kept = [c for h in labels.HORIZONS for c in (f"gross_{h}", f"above_{h}")]
    nets = [(F.col(f"gross_{h}") - F.col("cost")).alias(f"net_{h}") for h in labels.HORIZONS]
    ups = [F.when(F.col(f"gross_{h}").isNotNull(), (F.col(f"gross_{h}") - F.col("cost") > 0).cast("double")).alias(f"target_{h}") for h in labels.HORIZONS]
    return rounded(df.select("symbol", "bar", "regime", "cost", *kept, *nets, *ups), 8)


def liquidity_rank(spark, sf_dir):
    return rounded(labels.liquidity_rank(tables.bars(spark, sf_dir), F.lit("2000-06-30").cast("date")))


def regime_sma200(spark, sf_dir):
    return rounded(labels.regime_sma200(tables.bars(spark, sf_dir)))


def market_regime(spark, sf_dir):
    bench = tables.benchmark(tables.bars(spark, sf_dir))
    return rounded(labels.market_regime(bench, tables.vix(bench)))


def partition_by_progress(spark, sf_dir):
    return rounded(labels.by_progress(tables.bars(spark, sf_dir)).select("symbol", "bar", "partition", "close"))


def make_folds(spark, sf_dir):
    return rounded(labels.make_folds(tables.bars(spark, sf_dir)).withColumn("fold", F.col("fold").cast("long")))


def fold_assignment(spark, sf_dir):
    panel = tables.bars(spark, sf_dir).select("symbol", "bar")
    return rounded(labels.assign_folds(panel, labels.make_folds(panel)).select("fold", "role", "symbol", "bar"))


def benchmark_align(spark, sf_dir):
    panel = tables.bars(spark, sf_dir)
    # one value a month, so that it is carried on over the month's other bars
    monthly = tables.benchmark(panel).groupBy(F.date_trunc("month", "bar").alias("month")).agg(F.max("bar").alias("bar"), F.max_by("bclose", "bar").alias("bclose"))
    sparse = monthly.drop("month")
    return rounded(align_benchmark(panel.select("symbol", "bar", "close"), sparse))


def forward_path(spark, sf_dir):
    paths = joins.forward_path(tables.bars(spark, sf_dir), 5)
    return rounded(
        paths.select("symbol", "bar", F.size("path").cast("long").alias("n"), F.array_max(F.transform("path", lambda p: p["high"])).alias("top"), F.array_min(F.transform("path", lambda p: p["low"])).alias("bottom"))
    )


def tag_headlines(spark, sf_dir):
    return joins.tag_headlines(tables.headlines(spark, sf_dir), named(tables.universe(spark, sf_dir))).select("id", "affected")


def named(universe: DataFrame) -> DataFrame:
    """The universe with names that occur in texts: common syllables by rank."""
    words = F.array(*[F.lit(x) for x in ("tion the", "there re", "ment en", "ción la", "lich der", "thing to", "eaux les", "ando que")])
    return universe.withColumn("name", F.get(words, (F.col("rank") % 8).cast("int")))


NAMED = "SELECT rank, symbol, ['tion the', 'there re', 'ment en', 'ción la', 'lich der', 'thing to', 'eaux les', 'ando que'][rank % 8 + 1] AS name, sector, tier FROM universe"


def positions(spark, sf_dir):
    """Holdings by the ledger's running sums: what was bought at its average price, less what was sold."""
    side = F.when(F.col("side") == "BUY", F.col("qty")).otherwise(0)
    sold = F.when(F.col("side") == "SELL", F.col("qty")).otherwise(0)
    sums = tables.transactions(spark, sf_dir).groupBy("portfolio", "symbol").agg(
        F.sum(side).alias("bought"), F.sum(sold).alias("sold"), F.sum(side * F.col("price")).alias("paid")
    )
    held = sums.where("bought > sold")
    return held.select("portfolio", "symbol", (F.col("bought") - F.col("sold")).alias("qty"), (F.col("paid").cast("double") / F.col("bought")).cast("decimal(18,6)").cast("decimal(18,2)").alias("average"))


POSITIONS = """SELECT portfolio, symbol, (bought - sold)::BIGINT AS qty, (paid / bought)::DECIMAL(18,6)::DECIMAL(18,2) AS average FROM (
  SELECT portfolio, symbol, sum(CASE WHEN side = 'BUY' THEN qty ELSE 0 END) AS bought, sum(CASE WHEN side = 'SELL' THEN qty ELSE 0 END) AS sold,
  sum(CASE WHEN side = 'BUY' THEN qty * price ELSE 0 END)::DOUBLE AS paid FROM ledger GROUP BY ALL) WHERE bought > sold"""


def trades_enriched(spark, sf_dir):
    trades = tables.transactions(spark, sf_dir).select("portfolio", "symbol", "ts", "side", "qty", "price")
    return decimals(rounded(joins.enrich_trades(trades, tables.universe(spark, sf_dir), tables.quotes(tables.bars(spark, sf_dir)))))


def decimals(df: DataFrame) -> DataFrame:
    """Money as doubles, for results that are compared."""
    return df.select(*[F.col(c).cast("double").alias(c) if kind.startswith("decimal") else F.col(c) for c, kind in df.dtypes])


def watchlist_quotes(spark, sf_dir):
    items = tables.transactions(spark, sf_dir).where("side = 'BUY'").groupBy(F.col("portfolio").alias("owner"), "symbol").agg(F.max("ts").alias("added"))
    return rounded(joins.watch(items, tables.universe(spark, sf_dir), tables.quotes(tables.bars(spark, sf_dir))))


def exit_cooldown(spark, sf_dir):
    """Buys after which the same position wasn't sold in the week before: the cooldown with a longer span."""
    ledger = tables.transactions(spark, sf_dir).select("portfolio", "symbol", "ts", "side", "qty")
    sells = ledger.where("side = 'SELL'").select("portfolio", "symbol", "ts")
    return rounded(joins.without_recent_exit(ledger.where("side = 'BUY'").drop("side"), sells, 30 * 86400))


QUERIES = {f.__name__: f for f in (
    clean_candles, ohlc_anomalies, resample_ticks, resample_monthly, normalize_quotes, session_status, min_history, upsert_dimension, feed_items,
    event_props, net_labels, liquidity_rank, regime_sma200, market_regime, partition_by_progress, make_folds, fold_assignment, benchmark_align,
    forward_path, tag_headlines, trades_enriched, watchlist_quotes, exit_cooldown,
)}

COSTS = " UNION ALL ".join(f"SELECT '{name}' AS regime, {labels.round_trip_cost(name)!r} AS cost" for name in labels.COST_REGIMES)
LEADS = ", ".join(f"lead(close, {h}) OVER ws / close - 1 AS gross_{n}" for n, h in labels.HORIZONS.items())
FOLDS = """SELECT fold, greatest(first, (test_end - INTERVAL 36 MONTH)::DATE) AS train_start, (test_end - INTERVAL 12 MONTH)::DATE AS val_start,
  (test_end - INTERVAL 6 MONTH)::DATE AS test_start, test_end FROM (
  SELECT f AS fold, first, (wf_end - to_months((4 - f)::INT * 6))::DATE AS test_end FROM (
    SELECT max(bar) AS wf_end, (SELECT min(bar) FROM bars) AS first FROM bars WHERE bar < (SELECT (max(bar) - INTERVAL 6 MONTH)::DATE FROM bars)),
    range(1, 5) t(f))"""
REGIME = """SELECT bar, vix_level, annual_vol, CASE WHEN vix_level >= 22 OR (annual_vol >= 0.30 AND NOT above50) THEN 'PANIC'
    WHEN NOT above50 AND NOT above20 AND momentum < -0.03 THEN 'BEAR_TREND' WHEN above50 AND (vix_level >= 18 OR annual_vol > 0.25) THEN 'BULL_VOLATILE'
    WHEN above50 AND above20 AND vix_level < 18 THEN 'BULL_TREND' ELSE 'SIDEWAYS' END AS regime FROM (
  SELECT bar, coalesce(value, 14.5) AS vix_level, CASE WHEN n >= 50 THEN vol ELSE 0.14 END AS annual_vol, CASE WHEN n >= 50 THEN m ELSE 0 END AS momentum,
    CASE WHEN n >= 50 THEN a20 ELSE true END AS above20, CASE WHEN n >= 50 THEN a50 ELSE true END AS above50 FROM (
  SELECT bar, value, row_number() OVER o AS n, stddev_pop(rr) OVER w20 * sqrt(252) AS vol, bclose / lag(bclose, 20) OVER o - 1 AS m,
    bclose >= avg(bclose) OVER w20 AS a20, bclose >= avg(bclose) OVER w50 AS a50 FROM (
    SELECT *, bclose / lag(bclose) OVER (ORDER BY bar) - 1 AS rr FROM bench LEFT JOIN vix USING (bar))
    WINDOW o AS (ORDER BY bar), w20 AS (ORDER BY bar ROWS 19 PRECEDING), w50 AS (ORDER BY bar ROWS 49 PRECEDING)))"""

ORACLE_SQL = {
    "clean_candles": sql(
        f"SELECT symbol, time::VARCHAR AS time, {', '.join(CENTS.format(c) + ' AS ' + c for c in PX4.split())}, volume FROM numbers WHERE close IS NOT NULL AND high >= low "
        "QUALIFY row_number() OVER (PARTITION BY symbol, time ORDER BY seq) = 1",
        raw=RAW, numbers=NUMBERS,
    ),
    "ohlc_anomalies": sql(
        """SELECT symbol, count(*) AS candles, count(*) FILTER (high < greatest(open, close, low)) AS high_too_low, count(*) FILTER (low > least(open, close, high)) AS low_too_high,
        count(*) FILTER (least(open, high, low, close) <= 0) AS price_not_positive, count(*) FILTER (time <= before) AS not_ascending,
        count(*) FILTER (volume = 0) AS zero_volume, count(*) FILTER (open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL) AS missing
        FROM (SELECT *, lag(time) OVER (PARTITION BY symbol ORDER BY seq) AS before FROM numbers) GROUP BY symbol""",
        raw=RAW, numbers=NUMBERS,
    ),
    "resample_ticks": sql(
        f"SELECT symbol, bar::VARCHAR AS bar, {r(PX4 + ' volume')} FROM (SELECT symbol, time_bucket(INTERVAL 15 MINUTE, ts) AS bar, arg_min(px, seq) AS open, max(px) AS high, "
        "min(px) AS low, arg_max(px, seq) AS close, sum(qty)::DOUBLE AS volume FROM ticks GROUP BY ALL)"
    ),
    "resample_monthly": sql(
        f"SELECT symbol, bar::VARCHAR AS bar, {r(PX4 + ' volume')} FROM (SELECT symbol, date_trunc('month', l_shipdate)::DATE AS bar, arg_min(px, seq) AS open, max(px) AS high, "
        "min(px) AS low, arg_max(px, seq) AS close, sum(qty) AS volume FROM trades GROUP BY ALL)"
    ),
    "normalize_quotes": sql(
        f"""SELECT CASE WHEN upper(trim(symbol)) LIKE '%.NS' THEN upper(trim(symbol)) ELSE upper(trim(symbol)) || '.NS' END AS ticker,
        {CENTS.format('price')} AS price, {CENTS.format('price - b')} AS change, {CENTS.format('(price - b) / b * 100')} AS change_percent,
        {CENTS.format('greatest(high, price, b)')} AS day_high, {CENTS.format('least(low, price, b)')} AS day_low, {CENTS.format('b')} AS prev_close,
        {CENTS.format('open')} AS open, round(volume, 6) AS volume,
        CASE {SESSION.format(t="(bar + INTERVAL 570 MINUTE)")} WHEN 'OPEN' THEN 'LIVE' WHEN 'PRE_OPEN' THEN 'DELAYED' ELSE 'CLOSED' END AS freshness
        FROM (SELECT *, coalesce(nullif(prev_close, 0), price) AS b FROM quotes)"""
    ),
    "session_status": sql(f"SELECT symbol, seq, {SESSION.format(t='(ts + INTERVAL 330 MINUTE)')} AS status FROM ticks"),
    "min_history": sql(
        f"SELECT symbol, bar::VARCHAR AS bar, {r(PX4 + ' volume')} FROM bars WHERE symbol NOT IN (SELECT symbol FROM universe WHERE tier = 'SMALL') "
        "QUALIFY count(*) OVER (PARTITION BY symbol) >= 340"
    ),
    "upsert_dimension": sql(
        """SELECT symbol, coalesce(n.name, u.name) AS name, coalesce(n.sector, u.sector) AS sector FROM universe u FULL JOIN news n USING (symbol)""",
        news="""SELECT * FROM (SELECT p_brand AS symbol, p_name AS name, p_type AS sector, p_partkey FROM part
          UNION ALL SELECT p_brand || '/' || p_size, p_name, p_type, p_partkey FROM part)
          QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY p_partkey) = 1""",
    ),
    "feed_items": sql(
        r"""SELECT page_id, (i - 1)::INT AS position, trim(regexp_extract(items[i], '(?s)>(.*?)</a>', 1)) AS title, trim(regexp_extract(items[i], 'href="([^"]*)"', 1)) AS link
        FROM (SELECT page_id, items, unnest(range(1, len(items) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?s)(<a .*?</a>)') AS items FROM pages))
        WHERE title <> '' AND link <> ''"""
    ),
    "event_props": "SELECT event_id, json_extract(props, '$.k')::INT AS k, length('{\"k\":' || json_extract(props, '$.k')::INT || '}')::BIGINT AS size FROM events",
    "net_labels": sql(
        "SELECT symbol, bar::VARCHAR AS bar, regime, round(cost, 8) AS cost, "
        + ", ".join(
            f"round(gross_{h}, 8) + 0.0 AS gross_{h}, (gross_{h} > {t})::INT::DOUBLE AS above_{h}, round(gross_{h} - cost, 8) + 0.0 AS net_{h}, (gross_{h} - cost > 0)::INT::DOUBLE AS target_{h}"
            for h, t in zip(labels.HORIZONS, (0.003, 0.01, 0.03), strict=True)
        )
        + " FROM leads CROSS JOIN costs",
        leads=f"SELECT symbol, bar, {LEADS} FROM bars WINDOW ws AS (PARTITION BY symbol ORDER BY bar)",
        costs=COSTS,
    ),
    "liquidity_rank": sql(
        "SELECT symbol, round(turnover, 6) AS turnover, bars, (row_number() OVER (ORDER BY turnover DESC, symbol))::INT AS rank FROM (SELECT symbol, quantile_cont(close * volume, 0.5) AS turnover, count(*) AS bars "
        "FROM (SELECT * FROM bars WHERE bar <= DATE '2000-06-30' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar DESC) <= 60) GROUP BY symbol) WHERE bars >= 20 AND turnover > 0"
    ),
    "regime_sma200": sql(
        "SELECT symbol, bar::VARCHAR AS bar, CASE WHEN n < 200 THEN 'UNKNOWN' WHEN close > m THEN 'BULL' ELSE 'BEAR' END AS regime FROM (SELECT *, count(*) OVER w AS n, avg(close) OVER w AS m "
        "FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar ROWS 199 PRECEDING))"
    ),
    "market_regime": sql(
        """SELECT bar::VARCHAR AS bar, regime, round(annual_vol, 6) AS annual_vol, round(vix_level, 6) AS vix_level,
        CASE regime WHEN 'PANIC' THEN 0.9::DOUBLE WHEN 'BEAR_TREND' THEN 0.85 WHEN 'BULL_VOLATILE' THEN 0.8 WHEN 'BULL_TREND' THEN 0.88 ELSE 0.75 END AS confidence,
        CASE WHEN regime IN ('PANIC', 'BEAR_TREND') THEN 'BEARISH' WHEN regime = 'SIDEWAYS' THEN 'NEUTRAL' ELSE 'BULLISH' END AS trend FROM regime_of""",
        regime_of=REGIME,
    ),
    "partition_by_progress": sql(
        """SELECT symbol, bar::VARCHAR AS bar, CASE WHEN p < 0.5 THEN 'TRAIN' WHEN p < 0.75 THEN 'VALIDATION' WHEN p < 0.9 THEN 'TEST' ELSE 'HOLDOUT' END AS partition, round(close, 6) AS close
        FROM (SELECT *, (i - 55) / nullif(n - 76, 0)::DOUBLE AS p FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars))
        WHERE i >= 55 AND i <= n - 21 AND (i - 55) % 3 = 0 AND n > 76"""
    ),
    "make_folds": sql(
        "SELECT fold, train_start::VARCHAR AS train_start, val_start::VARCHAR AS train_end, val_start::VARCHAR AS val_start, test_start::VARCHAR AS val_end, test_start::VARCHAR AS test_start, test_end::VARCHAR AS test_end FROM folds",
        folds=FOLDS,
    ),
    "fold_assignment": sql(
        "SELECT fold::INT AS fold, role, symbol, bar::VARCHAR AS bar FROM bars JOIN ranges ON bar >= lo AND bar < hi",
        folds=FOLDS,
        ranges="SELECT fold, 'TRAIN' AS role, train_start AS lo, val_start AS hi FROM folds UNION ALL SELECT fold, 'VALIDATION', val_start, test_start FROM folds UNION ALL SELECT fold, 'TEST', test_start, test_end FROM folds",
    ),
    "benchmark_align": sql(
        "SELECT symbol, bar::VARCHAR AS bar, round(close, 6) AS close, round(last_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar ROWS UNBOUNDED PRECEDING), 6) AS bclose "
        "FROM (SELECT b.symbol, b.bar, b.close, s.bclose AS x FROM bars b LEFT JOIN (SELECT max(bar) AS bar, arg_max(bclose, bar) AS bclose FROM bench GROUP BY date_trunc('month', bar)) s ON b.bar = s.bar)"
    ),
    "forward_path": sql(
        "SELECT symbol, bar::VARCHAR AS bar, count(*) OVER w AS n, round(max(high) OVER w, 6) AS top, round(min(low) OVER w, 6) AS bottom FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"
    ),
    "tag_headlines": sql(
        "SELECT id, (SELECT arg_min(u.symbol, u.rank) FROM named u WHERE (length(u.symbol) >= 3 AND contains(lower(title), lower(u.symbol))) OR (length(string_split(u.name, ' ')[1]) >= 4 AND contains(lower(title), lower(string_split(u.name, ' ')[1])))) AS affected FROM headlines",
        named=NAMED,
    ),
    "trades_enriched": sql(
        """SELECT portfolio, symbol, ts::VARCHAR AS ts, side, qty, price::DOUBLE AS price, coalesce(sector, 'Equities') AS sector, cur::DOUBLE AS current_price, (cur - price)::DOUBLE AS delta,
        CASE WHEN price > 0 THEN round(round((cur - price)::DOUBLE / price::DOUBLE * 100, 2), 6) + 0.0 ELSE 0 END AS delta_percent, (qty * price)::DOUBLE AS total_value
        FROM (SELECT l.*, u.sector, coalesce(q.price, l.price::DOUBLE)::DECIMAL(18,2) AS cur FROM ledger l LEFT JOIN universe u USING (symbol) LEFT JOIN quotes q ON l.symbol = q.symbol)"""
    ),
    "watchlist_quotes": sql(
        "SELECT w.owner, symbol, w.added::VARCHAR AS added, u.name, round(q.price, 6) AS price FROM (SELECT portfolio AS owner, symbol, max(ts) AS added FROM ledger WHERE side = 'BUY' GROUP BY ALL) w JOIN universe u USING (symbol) JOIN quotes q USING (symbol)"
    ),
    "exit_cooldown": sql(
        "SELECT portfolio, symbol, ts::VARCHAR AS ts, qty FROM ledger s WHERE side = 'BUY' AND NOT EXISTS (SELECT 1 FROM ledger x WHERE x.side = 'SELL' AND x.portfolio = s.portfolio AND x.symbol = s.symbol AND x.ts < s.ts AND x.ts >= s.ts - INTERVAL 30 DAY)"
    ),
}
