"""Stateful streams over many batches in no order, with a restart from the checkpoint in the middle, against plain loops over all events."""

import datetime as dt
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import portfolio
from barloom.streaming import ordered, streams

START = dt.datetime(2024, 1, 1)


def landed(spark, rows, schema, path, name):
    """A file of rows in a folder; files are read in the order of their times."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    fresh = [f for f in os.listdir(path) if f.endswith(".parquet") and not f.startswith("b")]
    assert len(fresh) == 1
    os.rename(f"{path}/{fresh[0]}", f"{path}/b{name:03d}.parquet")
    os.utime(f"{path}/b{name:03d}.parquet", (1_700_000_000 + name, 1_700_000_000 + name))


def read(spark, path, schema, files=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def drain(stream, out, log):
    """Rows told by a run over what has landed; a second run goes on where the first one stopped."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def in_turns(spark, tmp_path, make, batches, schema):
    """``make`` of a stream whose files come one by one, stopped after half of them and started again."""
    source, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    half = len(batches) // 2
    for part in (range(half), range(half, len(batches))):
        for k in part:
            landed(spark, batches[k], schema, source, k)
        told = drain(make(read(spark, source, schema)), out, log)
    assert len([f for f in os.listdir(f"{log}/commits") if not f.startswith(".")]) >= len(batches)
    return told


def disordered(rows, n, spread, seed):
    """Rows (ts first) cut into ``n`` batches, each event at most ``spread`` late."""
    rng = random.Random(seed)
    late = sorted(rows, key=lambda r: r[0] + rng.random() * spread)
    size = -(-len(late) // n)
    return [late[k : k + size] for k in range(0, len(late), size)]


ORDERS = "ts timestamp, portfolio long, symbol string, side string, qty long, price double, seq_key string"


@pytest.mark.parametrize("late", ["2 days", "3650 days"], ids=["orders become final", "all orders wait"])
def test_ledger_in_shuffled_batches_equals_the_replay(spark, tmp_path, late):
    rng = random.Random(4)
    rows = [(START + dt.timedelta(hours=6 * rng.randint(0, 160)), rng.randint(1, 3), rng.choice("XYZ"), rng.choice(["BUY", "BUY", "SELL"]), rng.randint(-1, 400), round(rng.uniform(1, 900), 2), f"{k:05d}") for k in range(400)]
    batches = disordered(rows, 10, dt.timedelta(days=1.5), 1)
    told = in_turns(spark, tmp_path, lambda s: streams.ledger(s, late=late), batches, ORDERS)
    got = {r.portfolio: tuple(r)[1:] for r in streams.latest_standing(told).collect()}
    ledger = spark.createDataFrame(rows, ORDERS).withColumn("seq", F.struct(F.col("seq_key").alias("k")))
    want = {}
    for r in portfolio.replay(ledger).collect():
        _, n, *_ = want.get(r.portfolio, (0, 0))
        want[r.portfolio] = (r.cash, n + (r.symbol is not None), r.accepted, r.rejected)
    assert got == want and all(w[3] > 0 for w in want.values())
    waiting = [r.waiting for r in told.orderBy("portfolio", "version").collect()]
    assert (max(waiting) < 80) == (late == "2 days")


def test_portfolios_that_share_their_state(spark, tmp_path):
    rng = random.Random(5)
    rows = [(START + dt.timedelta(hours=6 * rng.randint(0, 160)), rng.randint(1, 7), rng.choice("XYZ"), rng.choice(["BUY", "BUY", "SELL"]), rng.randint(-1, 400), round(rng.uniform(1, 900), 2), f"{k:05d}") for k in range(600)]
    batches = disordered(rows, 6, dt.timedelta(days=1.5), 3)
    told = in_turns(spark, tmp_path, lambda s: streams.ledger(s, late="2 days", shares=2), batches, ORDERS)
    got = {r.portfolio: tuple(r)[1:] for r in streams.latest_standing(told).collect()}
    ledger = spark.createDataFrame(rows, ORDERS).withColumn("seq", F.struct(F.col("seq_key").alias("k")))
    want = {}
    for r in portfolio.replay(ledger).collect():
        _, n, *_ = want.get(r.portfolio, (0, 0))
        want[r.portfolio] = (r.cash, n + (r.symbol is not None), r.accepted, r.rejected)
    assert got == want and len(want) == 7 and max(r.waiting for r in told.collect()) < 60


class CountedState:
    """A handle whose states count the calls into them."""

    calls = 0

    def __getattr__(self, name):
        def call(*_):
            CountedState.calls += 1
            return {"exists": False, "get": None}.get(name, CountedState())

        return call


def test_the_ledger_calls_the_state_by_share_not_by_portfolio():
    held = ordered.Ledger(1000.0)
    held.init(CountedState())
    CountedState.calls = 0
    rows = [(k % 300, f"{k:04d}", k % 300, "X", "BUY", 1, 600.0) for k in range(900)]
    out = pd.concat(held.handleInputRows((0,), iter([pd.DataFrame(rows, columns=ordered.names(held.columns))]), None))
    assert len(out) == 300 and set(out.itertuples(index=False, name=None)) == {(p, 400.0, 1, 1, 2, 3, 1) for p in range(300)}
    assert CountedState.calls < 12


def test_a_sale_before_its_purchase_in_an_earlier_batch(spark, tmp_path):
    day = dt.timedelta(days=1)
    batches = [[(START + day, 1, "X", "SELL", 5, 10.0, "b")], [(START, 1, "X", "BUY", 5, 10.0, "a")]]
    told = in_turns(spark, tmp_path, lambda s: streams.ledger(s, late="5 days"), batches, ORDERS)
    assert [tuple(r) for r in streams.latest_standing(told).collect()] == [(1, 1_000_000.0, 0, 2, 0)]


TICKS = "ts timestamp, symbol string, px double, seq long, portfolio long"


def plain_exits(events, stop, target, cooldown):
    """(portfolio, symbol, ts, reason) by a loop over (ts, is a hit, seq, symbol, px, portfolio of a sell)."""
    out, last = [], {}
    for ts, hit, _, symbol, px, owner in sorted(events, key=lambda e: e[:3]):
        for p in (1, 2) if hit else (owner,):
            before = last.get((p, symbol))
            free = before is None or (ts - before).total_seconds() > cooldown
            if not hit:
                last[p, symbol] = ts
            elif free and (px <= stop or px >= target):
                last[p, symbol] = ts
                out.append((p, symbol, ts, "STOP" if px <= stop else "TARGET"))
    return out


def test_exits_know_of_sells_and_of_earlier_batches(spark, tmp_path):
    rng = random.Random(6)
    quotes = [(START + dt.timedelta(seconds=rng.randint(0, 7200)), rng.choice("AB"), rng.choice([5.0, 50.0, 95.0]), k, None) for k in range(300)]
    sells = [(START + dt.timedelta(seconds=rng.randint(0, 7200)), rng.choice("AB"), None, k, rng.randint(1, 2)) for k in range(60)]
    end = (START + dt.timedelta(days=2), "-", 50.0, 10_000, None), (START + dt.timedelta(days=2), "-", None, 10_000, 9)
    batches = disordered([*quotes, *sells], 6, dt.timedelta(minutes=4), 2) + [list(end)]
    held = spark.createDataFrame([(p, s, 10.0, 90.0) for p in (1, 2) for s in "AB"], "portfolio long, symbol string, stop double, target double")

    def make(stream):
        return streams.exits(stream.where("px IS NOT NULL").drop("portfolio"), held, 60_000, stream.where("px IS NULL").select("portfolio", "symbol", "ts"), "5 minutes")

    got = in_turns(spark, tmp_path, make, batches, TICKS)
    events = [(ts, True, k, s, px, None) for ts, s, px, k, _ in quotes] + [(ts, False, -1, s, None, p) for ts, s, _, _, p in sells]
    want = plain_exits(events, 10.0, 90.0, 60)
    assert sorted((r.portfolio, r.symbol, r.ts, r.reason) for r in got.collect()) == sorted(want)
    assert len(want) < len(plain_exits([e for e in events if e[1]], 10.0, 90.0, 60))  # sells held exits back


def test_alerts_fire_once_at_the_earliest_price(spark, tmp_path):
    def minute(m):
        return START + dt.timedelta(minutes=m)

    batches = [
        [(minute(6), "A", 95.0, 3, None)],
        [(minute(2), "A", 91.0, 1, None), (minute(2), "A", 92.0, 0, None), (minute(3), "B", 50.0, 2, None)],
        [(minute(60), "A", 99.0, 5, None), (minute(61), "B", 5.0, 6, None)],
        [(minute(90), "A", 97.0, 7, None), (minute(400), "-", 1.0, 9, None)],
        [(minute(401), "A", 97.0, 10, None)],
    ]
    wanted = spark.createDataFrame([(1, "A", 90.0, "ABOVE"), (2, "B", 10.0, "BELOW"), (3, "A", 10.0, "BELOW")], "alert long, symbol string, level double, condition string")
    got = in_turns(spark, tmp_path, lambda s: streams.alerts(s, wanted), batches, TICKS)
    assert sorted((r.alert, r.ts, r.px) for r in got.collect()) == [(1, minute(2), 92.0), (2, minute(61), 5.0)]
