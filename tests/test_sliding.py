"""Falls from a peak over sliding windows against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import features, outcomes


def plain(values):
    peak, deepest = None, 0.0
    for x in values:
        peak = x if peak is None else max(peak, x)
        deepest = max(deepest, (peak - x) / peak)
    return deepest


@pytest.mark.parametrize("n", [1, 2, 7, 60])
def test_falls_within_the_last_rows(spark, n):
    rng = random.Random(n)
    walks = {"A": [100.0], "B": [50.0 + k for k in range(70)], "C": [90.0 - k for k in range(70)], "D": [round(rng.uniform(1, 9), 2) for _ in range(200)], "E": [7.0] * 65}
    rows = [(s, k, x) for s, xs in walks.items() for k, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "symbol string, rn long, close double").withColumn("bar", F.col("rn")).repartition(3)
    got = features.sliding_drawdowns(df, "close", {"fall": n}).select("symbol", "rn", "fall").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.fall == plain(walks[r.symbol][max(0, r.rn - n + 1) : r.rn + 1]), r


def first_touch(bars, i, side, stop, target, h):
    """(reason, bar's number, price) by looking at one bar after the other; None without h bars."""
    if i + h >= len(bars):
        return None
    for j in range(i + 1, i + h + 1):
        high, low, _ = bars[j]
        stopped, reached = (low <= stop, high >= target) if side == "LONG" else (high >= stop, low <= target)
        if stopped or reached:
            return ("STOP_LOSS", j, stop) if stopped else ("TARGET_PROFIT", j, target)
    return "HORIZON_EXPIRY", i + h, bars[i + h][2]


def test_first_barriers_of_long_horizons(spark):
    rng = random.Random(9)
    panel, signals, want = [], [], {}
    for s in "AB":
        close, bars = 100.0, []
        for k in range(420):
            close *= 1 + rng.uniform(-0.02, 0.021)
            bars.append((round(close * 1.01, 4), round(close * 0.99, 4), round(close, 4)))
            panel.append((s, k, *bars[-1]))
        for k in range(420):
            side, h, width = rng.choice(["LONG", "SHORT"]), rng.choice([1, 15, 16, 17, 32, 33, 100, 250]), rng.choice([0.02, 0.1, 0.3])
            sign = 1 if side == "LONG" else -1
            stop, target = bars[k][2] * (1 - sign * width), bars[k][2] * (1 + sign * width)
            signals.append((s, k, bars[k][2], side, stop, target, h))
            if found := first_touch(bars, k, side, stop, target, h):
                want[s, k] = (*found, found[1] - k)
    df = outcomes.long_path_outcomes(spark.createDataFrame(signals, "symbol string, bar int, close double, side string, stop double, target double, h int"), spark.createDataFrame(panel, "symbol string, bar int, high double, low double, close double").repartition(3), 250)
    assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.symbol, r.bar): (r.exit_reason, r.exit_bar, r.exit_price) for r in df.collect()} == {k: w[:3] for k, w in want.items()}
    assert {w[0] for w in want.values()} == {"STOP_LOSS", "TARGET_PROFIT", "HORIZON_EXPIRY"} and sum(w[3] > 48 and w[0] != "HORIZON_EXPIRY" for w in want.values()) > 10
