"""Landed quotes as a stream source: polls of a span of time, read in partitions of a few symbols each.

Quotes lie in a Parquet file or folder that pyarrow can open. A poll ends where the next ``step`` seconds of them end, or with the newest one; where it ends
is known from the files' statistics, without reading a row. A partition asks for the quotes of up to ``PER_POLL`` symbols, so a poll spreads over tasks by
symbols; rows and columns are picked in the scan. The last finished poll is written to ``commits``, from where a new reader goes on.

Quotes must land in the order of time: those that come later with an earlier time are not seen. Null and zero prices are left out.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from barloom.sources.shared import shared_path, ship

#: Symbols asked for at once.
PER_POLL = 15
BEFORE_ALL = -(1 << 62)


@dataclass
class Poll(InputPartition):
    symbols: list[str]
    start: int
    end: int

    def __init__(self, symbols: list[str], start: int, end: int):
        super().__init__((tuple(symbols), start, end))
        self.symbols, self.start, self.end = symbols, start, end


def at(value) -> int:
    """A time from a file's statistics in microseconds; without a zone it is UTC."""
    scalar = pa.scalar(value)
    return scalar.cast(pa.timestamp("us", tz=scalar.type.tz) if pa.types.is_timestamp(scalar.type) else pa.timestamp("us")).value


class QuoteReader(DataSourceStreamReader):
    """Options: ``path``; ``columns`` of symbol, time, price and number; ``symbols`` as JSON; ``step`` in seconds (0: all that has landed); ``commits``, a file."""

    def __init__(self, options: dict):
        self.path, self.columns = options["path"].removeprefix("file:"), options["columns"].split(",")
        self.symbols, self.step, self.commits = sorted(json.loads(options["symbols"])), int(float(options.get("step", "0")) * 1_000_000), options.get("commits")
        self.done = self.committed()

    def committed(self) -> int:
        if self.commits:
            store, name = fs.FileSystem.from_uri(self.commits)
            if store.get_file_info(name).type == fs.FileType.File:
                with store.open_input_stream(name) as file:
                    return json.loads(file.read())["until"]
        return BEFORE_ALL

    def span(self) -> tuple[int, int] | None:
        """First and last time of what has landed, from the files' statistics."""
        low = high = None
        for fragment in ds.dataset(self.path, format="parquet").get_fragments():
            for group in fragment.row_groups:
                told = (group.statistics or {}).get(self.columns[1])
                if told is None:
                    column = fragment.to_table(columns=[self.columns[1]])[self.columns[1]]
                    told = pc.min_max(column).as_py()
                if told["min"] is not None:
                    low = at(told["min"]) if low is None else min(low, at(told["min"]))
                    high = at(told["max"]) if high is None else max(high, at(told["max"]))
        return None if high is None else (low, high)

    def initialOffset(self) -> dict:
        return {"until": BEFORE_ALL}

    def latestOffset(self) -> dict:
        span = self.span()
        if span and self.done < span[1]:
            begin = max(self.done, span[0] - 1)
            self.done = min(begin + self.step, span[1]) if self.step else span[1]
        return {"until": self.done}

    def partitions(self, start: dict, end: dict) -> list[Poll]:
        return [Poll(self.symbols[k : k + PER_POLL], start["until"], end["until"]) for k in range(0, len(self.symbols), PER_POLL)] if start["until"] < end["until"] else []

    def read(self, partition: Poll) -> Iterator[pa.RecordBatch]:
        symbol, ts, price, seq = self.columns
        data = ds.dataset(self.path, format="parquet")
        zone = data.schema.field(ts).type.tz
        first, last = (pa.scalar(max(-(1 << 61), x), pa.timestamp("us", tz=zone)) for x in (partition.start, partition.end))
        wanted = ds.field(symbol).isin(partition.symbols) & (ds.field(ts) <= last) & (ds.field(price) != 0)
        if partition.start > BEFORE_ALL:
            wanted &= ds.field(ts) > first
        for batch in data.to_batches(columns=self.columns, filter=wanted):
            if batch.num_rows:
                times = batch.column(1).cast(pa.timestamp("us", tz=zone))
                times = pc.assume_timezone(times, "UTC") if zone is None else times
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), times, batch.column(2).cast(pa.float64()), batch.column(3).cast(pa.int64())], ["symbol", "ts", "px", "seq"])

    def commit(self, end: dict) -> None:
        if self.commits:
            store, name = fs.FileSystem.from_uri(self.commits)
            with store.open_output_stream(name) as file:
                file.write(json.dumps(end).encode())

    def stop(self) -> None:
        pass


class Quotes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quotes"

    def schema(self) -> str:
        return "symbol string, ts timestamp, px double, seq long"

    def streamReader(self, schema) -> QuoteReader:
        return QuoteReader(dict(self.options))


def quote_stream(spark: SparkSession, path: str, symbols: list[str], columns: str = "symbol,ts,px,seq", step: float = 0, commits: str | None = None) -> DataFrame:
    """Quotes (symbol, ts, px, seq) of ``symbols``, a bounded list, as a stream."""
    ship(spark)
    # the driver's own Python process that plans a source doesn't get what is shipped to the executors
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(Quotes)
    commits = commits or f"{shared_path(spark, 'quotes')}.json"
    store, name = fs.FileSystem.from_uri(commits)
    store.create_dir(name.rpartition("/")[0], recursive=True)
    return spark.readStream.format("quotes").options(path=path, columns=columns, symbols=json.dumps(symbols), step=str(step), commits=commits).load()
