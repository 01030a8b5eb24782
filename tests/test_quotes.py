"""Landed quotes as a polled source: polls, partitions by symbols, new files, and going on after a stop."""

import datetime as dt
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from barloom.sources import quotes
from barloom.streaming import streams

START = dt.datetime(2024, 3, 1)
SYMBOLS = [f"S{k:02d}" for k in range(40)]


def land(folder, name, rows, zone=None):
    folder.mkdir(exist_ok=True)
    cols = list(zip(*rows, strict=True))
    table = pa.table({"symbol": pa.array(cols[0]), "ts": pa.array(cols[1], pa.timestamp("us", tz=zone)), "px": pa.array(cols[2], pa.float64()), "seq": pa.array(cols[3])})
    pq.write_table(table, folder / f"{name}.parquet", row_group_size=50)


def some(first, hours, seed):
    rng = random.Random(seed)
    return [(rng.choice(SYMBOLS), START + dt.timedelta(seconds=rng.randint(first * 3600, (first + hours) * 3600 - 1)), rng.choice([0.0, None, 3.5, 7.0]), k) for k in range(300)]


def kept(rows):
    return sorted((s, t, p, k) for s, t, p, k in rows if p)


def options(folder, **more):
    return {"path": str(folder), "columns": "symbol,ts,px,seq", "symbols": quotes.json.dumps(SYMBOLS)} | more


@pytest.mark.parametrize("zone", [None, "UTC"])
def test_polls_cover_all_quotes_once(tmp_path, zone):
    rows = some(0, 10, 1)
    land(tmp_path / "in", "a", rows, zone)
    reader = quotes.QuoteReader(options(tmp_path / "in", step="7200"))
    at, got, polls = reader.initialOffset(), [], 0
    while (end := reader.latestOffset()) != at:
        parts = reader.partitions(at, end)
        assert [len(p.symbols) for p in parts] == [15, 15, 10]
        for p in parts:
            for batch in reader.read(p):
                got += [(r["symbol"], r["ts"].replace(tzinfo=None), r["px"], r["seq"]) for r in batch.to_pylist()]
        at, polls = end, polls + 1
    assert sorted(got) == kept(rows) and polls == 5
    assert reader.partitions(at, at) == []


def test_a_new_reader_goes_on_after_the_last_commit(tmp_path):
    land(tmp_path / "in", "a", some(0, 10, 1))
    told = options(tmp_path / "in", step="3600", commits=str(tmp_path / "done.json"))
    reader = quotes.QuoteReader(told)
    first, second = reader.latestOffset(), reader.latestOffset()
    reader.commit(first)
    assert quotes.QuoteReader(told).latestOffset() == second != first


def test_nothing_has_landed(tmp_path):
    (tmp_path / "in").mkdir()
    reader = quotes.QuoteReader(options(tmp_path / "in"))
    assert reader.latestOffset() == reader.initialOffset()


def test_stream_of_quotes_over_a_restart(spark, tmp_path):
    first, then = some(0, 10, 2), some(10, 10, 3)
    land(tmp_path / "in", "a", first)
    out, log, done = (str(tmp_path / x) for x in ("out", "log", "done.json"))

    def run():
        stream = quotes.quote_stream(spark, str(tmp_path / "in"), SYMBOLS, step=4 * 3600, commits=done)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).start()
        query.processAllAvailable()
        query.stop()
        return sorted((r.symbol, r.ts, r.px, r.seq) for r in spark.read.schema(stream.schema).parquet(out).collect())

    assert run() == kept(first)
    land(tmp_path / "in", "b", then)
    assert run() == kept(first + then)


def test_latest_quotes_of_a_polled_stream(spark, tmp_path):
    rows = some(0, 10, 4)
    land(tmp_path / "in", "a", rows)
    stream = quotes.quote_stream(spark, str(tmp_path / "in"), SYMBOLS, step=4 * 3600)
    got = {r.symbol: (r.ts, r.px) for r in streams.drained(streams.latest_quotes(stream), "t-latest", "complete", polled=True).collect()}
    want = {}
    for s, t, p, k in sorted(kept(rows), key=lambda r: (r[1], r[3])):
        want[s] = (t, p)
    assert got == want
