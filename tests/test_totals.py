"""Sketched quantiles against their bound, and totals over several sets of keys against plain sums."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from barloom.operators import outcomes, portfolio, quantiles

RANKS = [0.95, 0.5, 0.05]


def test_sketches_of_months_keep_their_bound_when_merged(spark):
    # six months of 20,000 values each, far more than a sketch of 100 keeps; one key holds nearly all
    rows = spark.range(120_000).select(
        F.when(F.col("id") % 49 == 0, "rare").otherwise("hot").alias("k"), F.expr("make_date(2023, 7 + CAST(id % 6 AS int), 1 + CAST(id % 28 AS int))").alias("day"), (F.pow(F.pmod(F.xxhash64("id"), F.lit(100_003)) / 100_003.0, 3)).alias("x")
    )
    rows = rows.unionByName(spark.createDataFrame([("none", dt.date(2023, 7, 1), None)], rows.schema))
    for kept, least in ((100, 0.0005), (800, 0.0)):
        sketches = quantiles.monthly(rows, ["k"], "x", "day", kept)
        assert sketches.count() == 12
        told = quantiles.off_by(rows, quantiles.windowed(sketches, ["k"], 4), ["k"], "x", "day", 4, RANKS).collect()
        assert len(told) == 12 and sorted(r.n // 19_000 for r in told if r.k == "hot") == [1, 2, 3, 4, 4, 4]
        assert all(r.error <= 3 * quantiles.rank_error(kept) + 1 / r.n for r in told)
        assert max(r.error for r in told if r.k == "hot") > least  # the small sketch is no copy of its values
    truth = quantiles.exact(rows, ["k"], "x", "day", 4, RANKS).where("k = 'rare'").collect()
    values = {}
    for r in rows.where("k = 'rare'").collect():
        values.setdefault(r.day.replace(day=1), []).append(r.x)
    for r in truth:
        own = [x for m, xs in values.items() for x in xs if m <= r.month and (r.month.year - m.year) * 12 + r.month.month - m.month < 4]
        assert r.seen == len(own) and np.allclose(r.exact, np.quantile(own, RANKS))


def test_small_groups_have_exact_sketches(spark):
    rows = spark.createDataFrame([("a", dt.date(2024, 1, 5), float(x)) for x in range(11)], "k string, day date, x double")
    [r] = quantiles.windowed(quantiles.monthly(rows, ["k"], "x", "day"), ["k"], 3).select(quantiles.quantile("sketch", 0.5).alias("q"), "n").collect()
    assert (r.q, r.n) == (5.0, 11)


def test_metrics_with_subtotals(spark):
    rng = random.Random(2)
    trades = [(rng.choice(["A", "B", None]), rng.choice(["1d", "5d"]), rng.uniform(-1, 1), rng.uniform(-1, 1), rng.choice(["TARGET_PROFIT", "STOP_LOSS"])) for _ in range(200)]
    df = spark.createDataFrame(trades, "partition string, horizon string, gross double, net double, exit_reason string")
    got = {(r.partition, r.horizon): r for r in outcomes.trade_metrics(df, ["partition", "horizon"], [["horizon"], []]).collect()}
    assert len(got) == 9
    for (p, h), r in got.items():
        own = [t for t in trades if p in ("ALL", t[0]) and h in ("ALL", t[1])]
        assert r.trades == len(own) and np.isclose(r.avg_return, 100 * np.mean([t[3] for t in own])) and np.isclose(r.win_rate, 100 * np.mean([t[2] > 0 for t in own]))


def test_drill_down_by_portfolio_and_sector(spark):
    rng = random.Random(3)
    sectors = {"X": "Iron", "Y": "Wood", "Z": None}
    held = [(p, s, rng.randint(1, 90) * 1000) for p in (1, 2, 3) for s in "XYZ" if (p, s) != (2, "Y")]
    valued = spark.createDataFrame([(p, s, v // 2, v, 7) for p, s, v in held], "portfolio long, symbol string, invested long, current_value long, today_pnl long")
    got = portfolio.drill_down(valued, spark.createDataFrame(list(sectors.items()), "symbol string, sector string"), 1000.0).collect()
    assert len(got) == 8 + 3 + 3 + 1
    for r in got:
        own = [(p, s, v) for p, s, v in held if r.portfolio in (None, p) and r.sector in (None, sectors[s] or "General")]
        assert (r.positions, float(r.current_value), float(r.pnl)) == (len(own), sum(v for *_, v in own), sum(v - v // 2 for *_, v in own))
        assert r.level == {(0, 0): "SECTOR_OF_PORTFOLIO", (0, 1): "PORTFOLIO", (1, 0): "SECTOR", (1, 1): "ALL"}[r.portfolio is None, r.sector is None]
        if r.portfolio is None:
            assert r.weight is None and r.alert == 0
        else:
            weight = sum(v for *_, v in own) / (sum(v for p, _, v in held if p == r.portfolio) + 1000) * 100
            assert np.isclose(r.weight, weight) and r.alert == int(r.sector is not None and weight >= 40)
