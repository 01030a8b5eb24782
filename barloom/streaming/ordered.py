"""Stateful stream operators in the order of events: rows wait in the state until the watermark has passed them, whatever batches they came in.

State lives in RocksDB by key; timers of the event time wake a key only when rows of its own are due. What waits is bounded by the
watermark's delay. Rows that come after the watermark has passed them are dropped by Spark.

Each call into the state is a round trip between Python and the JVM, and each key is a frame in and a frame out. So rows that came together wait as arrays in
one element of the state, and a processor whose keys are many and small (the ledger) can take several of them under one.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import batched

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from barloom.operators.portfolio import execute
from barloom.sources.shared import ship

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Rows of one element of what waits at most.
TOGETHER = 1000


def names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]


def run(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str) -> DataFrame:
    """``rows`` (with a watermark) by key through a processor; the session gets the state store that timers and lists need."""
    spark: SparkSession = rows.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def packed(rows: list[tuple]) -> list[tuple]:
    """Rows as a few elements that hold an array per column."""
    return [tuple(list(column) for column in zip(*some, strict=True)) for some in batched(rows, TOGETHER)]


class InOrder(StatefulProcessor):
    """Keeps a key's rows until no earlier ones can come, and releases them by (at, seq). ``columns`` begin with ``at`` (microseconds) and ``seq``."""

    def __init__(self, columns: str):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(f"{name} array<{kind}>" for name, kind in (x.split() for x in self.columns.split(", "))))
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        more, came = self.due.get() is not None, []
        for batch in rows:
            some = list(batch[names(self.columns)].itertuples(index=False, name=None))
            self.waiting.appendList(packed(some))
            self.wake(int(batch["at"].min()))
            came += some
        yield from self.taken(came, more)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.due.clear()
        rows = self.ordered()
        cut = bisect_right(rows, passed, key=lambda r: r[0])
        if cut:
            yield from self.released(key, rows[:cut])
            if rows[cut:]:
                self.waiting.put(packed(rows[cut:]))
            else:
                self.waiting.clear()
        if rows[cut:]:
            self.wake(rows[cut][0])
        else:
            self.idle(passed)

    def ordered(self) -> list[tuple]:
        return sorted(self.all_waiting(), key=lambda r: (r[0], r[1]))

    def all_waiting(self) -> Iterator[tuple]:
        for columns in self.waiting.get():
            yield from zip(*columns, strict=True)

    def wake(self, at: int) -> None:
        """Have a timer for the first millisecond that ``at`` lies in or before."""
        due = self.due.get()
        if due is None or at < due[0]:
            if due is not None:
                self.handle.deleteTimer(-(-due[0] // 1000))
            self.handle.registerTimer(-(-at // 1000))
            self.due.update((at,))

    def taken(self, came: list[tuple], more: bool) -> Iterator[pd.DataFrame]:
        """What is told when rows have come; with ``more`` others waited before them."""
        yield from ()

    def released(self, key: tuple, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        """What is told of rows that are now final."""
        raise NotImplementedError

    def idle(self, passed: int) -> None:
        """Nothing waits any more."""

    def close(self) -> None:
        pass


class Exits(InOrder):
    """One exit of a position (portfolio, symbol) at the first hit that comes more than a cooldown after its last exit or sell.

    Rows without a ``reason`` are sells by hand; with ``seq`` -1 they stand before hits of their instant. The last exit is forgotten after the cooldown.
    """

    OUT = "portfolio long, symbol string, at long, px double, reason string"

    def __init__(self, cooldown_ms: int):
        super().__init__("at long, seq long, px double, reason string")
        self.cooldown = cooldown_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "at long")

    def released(self, key: tuple, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        last = self.last.get()
        last = last[0] if last else None
        out = []
        for at, _, px, reason in rows:
            free = last is None or at // 1000 - last // 1000 > self.cooldown
            if reason is None or free:
                last = at
            if reason is not None and free:
                out.append((*key, at, px, reason))
        if last is not None:
            self.last.update((last,))
        if out:
            yield pd.DataFrame(out, columns=names(self.OUT))

    def idle(self, passed: int) -> None:
        last = self.last.get()
        if last:
            over = last[0] + (self.cooldown + 1) * 1000
            if over <= passed:
                self.last.clear()
            else:
                self.wake(over)


class Alerts(StatefulProcessor):
    """The first price that meets an alert, once; of the prices so far only the earliest is kept until the watermark has passed it."""

    OUT = "alert long, at long, px double"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "at long, seq long, px double")
        self.fired = handle.getValueState("fired", "fired boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        before = self.first.get()
        best = before
        for batch in rows:
            low = batch.nsmallest(1, ["at", "seq"]).iloc[0]
            one = (int(low["at"]), int(low["seq"]), float(low["px"]))
            best = one if best is None or one[:2] < tuple(best)[:2] else best
        if not self.fired.exists() and best is not before:
            if before is not None:
                self.handle.deleteTimer(-(-before[0] // 1000))
            self.first.update(tuple(best))
            self.handle.registerTimer(-(-best[0] // 1000))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, _, px = self.first.get()
        self.fired.update((True,))
        self.first.clear()
        yield pd.DataFrame([(*key, at, px)], columns=names(self.OUT))

    def close(self) -> None:
        pass


class Ledger(InOrder):
    """Portfolios' orders executed in the order of events. A key holds one portfolio or several.

    After each batch it tells where the portfolios that traded stand with all orders known so far: those that are final are in the state (maps of cash and
    counts, and of holdings), those that wait are executed on top of it without being kept. ``version`` grows with every row of a portfolio.
    """

    OUT = "portfolio long, cash double, positions long, accepted long, rejected long, waiting long, version long"

    def __init__(self, cash: float):
        super().__init__("at long, seq string, portfolio long, symbol string, side string, qty long, price double")
        self.cash = cash

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.account = handle.getMapState("account", "portfolio long", "cash double, accepted long, rejected long")
        self.version = handle.getValueState("version", "n long")
        self.held = handle.getMapState("held", "portfolio long, symbol string", "qty long, average double")

    def final(self) -> tuple[dict[int, tuple], dict[int, dict[str, tuple]]]:
        """Accounts and holdings by portfolio, of the orders that are final."""
        held: dict[int, dict[str, tuple]] = defaultdict(dict)
        if not self.account.exists():
            return {}, held
        for (portfolio, symbol), x in self.held.iterator():
            held[portfolio][symbol] = tuple(x)
        return {p[0]: tuple(x) for p, x in self.account.iterator()}, held

    def executed(self, rows: Iterable[tuple], accounts: dict[int, tuple], held: dict[int, dict[str, tuple]]) -> Iterator[tuple]:
        """(portfolio, cash, holdings, accepted, rejected, orders) after ``rows``, which are in order."""
        turns = defaultdict(list)
        for r in rows:
            turns[r[2]].append(r[3:])
        for portfolio, orders in turns.items():
            cash, accepted, rejected = accounts.get(portfolio, (self.cash, 0, 0))
            cash, holdings, counts = execute(orders, cash, held.get(portfolio, {}))
            yield portfolio, cash, holdings, accepted + counts[0], rejected + counts[1], len(orders)

    def taken(self, came: list[tuple], more: bool) -> Iterator[pd.DataFrame]:
        if more:
            traded = {r[2] for r in came}
            came = [r for r in self.all_waiting() if r[2] in traded]
        version = (self.version.get() or (0,))[0] + 1
        self.version.update((version,))
        done = self.executed(sorted(came, key=lambda r: (r[0], r[1])), *self.final())
        yield pd.DataFrame([(p, cash, len(holdings), *counts, version) for p, cash, holdings, *counts in done], columns=names(self.OUT))

    def released(self, key: tuple, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        accounts, held = self.final()
        for portfolio, cash, holdings, accepted, rejected, _ in self.executed(rows, accounts, held):
            self.account.updateValue((portfolio,), (cash, accepted, rejected))
            before = held.get(portfolio, {})
            for symbol, holding in holdings.items():
                if before.get(symbol) != holding:
                    self.held.updateValue((portfolio, symbol), holding)
            for symbol in before.keys() - holdings.keys():
                self.held.removeKey((portfolio, symbol))
        yield from ()
