"""Registered queries against DuckDB on the smallest tables, where these are at hand."""

import os
from collections import Counter

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
LIGHT = ["resample_bars", "clean_candles", "ohlc_anomalies", "normalize_quotes", "net_labels", "make_folds", "fold_assignment", "position_values", "trades_enriched", "classify_headlines", "feed_items", "stream_bars", "feature_grid",
         "decisions", "warm_features", "trade_journal", "user_alerts", "stream_sentiment", "stored_predictions", "score_logistic", "release_gates", "rolling_summary"]


def rows(df: pd.DataFrame) -> Counter:
    def show(v) -> str:
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return "~"
        return f"{v:.5g}" if isinstance(v, float) else str(v)

    return Counter(tuple(show(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the tables")
@pytest.mark.parametrize("name", LIGHT)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert rows(entry.queries()[name](spark, DATA).toPandas()) == rows(con.sql(entry.oracle_sql()[name]).df())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the tables")
def test_stream_exits_equal_a_plain_loop(spark):
    ticks = spark.read.parquet(f"{DATA}/events.parquet").where("value <> 0").selectExpr("event_type AS symbol", "CAST(ts AS timestamp) AS ts", "value AS px", "event_id AS seq").toPandas().sort_values(["ts", "seq"])
    want = []
    for symbol, own in ticks.groupby("symbol"):
        stop, target = own["px"].quantile([0.02, 0.98])
        last = None
        for r in own.itertuples():
            at = r.ts.value // 1_000_000
            if (r.px <= stop or r.px >= target) and (last is None or at - last > 3_600_000):
                last = at
                want += [(p, symbol, str(r.ts).rstrip("0").rstrip("."), round(r.px, 6), "STOP" if r.px <= stop else "TARGET") for p in (1, 2)]
    got = [(r.portfolio, r.symbol, r.ts, r.px, r.reason) for r in entry.queries()["stream_exits"](spark, DATA).collect()]
    assert Counter((p, s, pd.Timestamp(t), x, why) for p, s, t, x, why in got) == Counter((p, s, pd.Timestamp(t), x, why) for p, s, t, x, why in want) and len(want) > 20


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the tables")
def test_stream_ledger_and_replay_equal_a_plain_loop(spark):
    from barloom.sources import tables
    from tests.test_operators import replayed

    ledger = tables.transactions(spark, DATA).selectExpr("portfolio", "symbol", "side", "qty", "CAST(price AS double) AS price", "ts", "to_json(seq) AS k").toPandas().sort_values(["ts", "k"])
    want = {p: replayed(own[["symbol", "side", "qty", "price"]].itertuples(index=False)) for p, own in ledger.groupby("portfolio")}
    got = entry.queries()["stream_ledger"](spark, DATA).collect()
    assert {r.portfolio: (r.cash, r.positions, r.accepted, r.rejected) for r in got} == {p: (round(c, 6), len(h), *n) for p, (c, h, n) in want.items()}
    rows = entry.queries()["ledger_replay"](spark, DATA).collect()
    assert {(r.portfolio, r.symbol, r.qty, r.average) for r in rows if r.symbol} == {(p, s, q, a) for p, (_, h, _) in want.items() for s, (q, a) in h.items()}


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
