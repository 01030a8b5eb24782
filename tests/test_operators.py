"""Operators on panels: small examples, invariants and independent recomputation."""

import datetime as dt
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import columns
from barloom.operators import cleaning, features, joins, labels, models, news, outcomes, portfolio, recurrence, scoring
from barloom.sources import files


def panel_of(spark, closes, symbol="A", **other):
    start = dt.date(2020, 1, 1)
    rows = [(symbol, start + dt.timedelta(days=k), float(c) - 0.5, float(c) + 1, float(c) - 2, float(c), 1_000_000.0) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, bar date, open double, high double, low double, close double, volume double")


def walk(n, seed=1):
    return (100 * np.exp(np.cumsum(np.random.default_rng(seed).normal(0, 0.02, n)))).tolist()


def test_exponential_means_equal_pandas(spark):
    closes = walk(700)
    df = recurrence.ema(recurrence.numbered(panel_of(spark, closes)), {"e": ("close", 2 / 13)}).orderBy("bar").toPandas()
    assert np.allclose(df["e"], pd.Series(closes).ewm(span=12, adjust=False).mean(), rtol=1e-12)


def test_features_equal_pandas(spark):
    closes = walk(320)
    panel = panel_of(spark, closes)
    bench = panel_of(spark, walk(320, 2)).select("bar", F.col("close").alias("bclose"))
    got = features.feature_panel(panel, bench).orderBy("bar").toPandas()
    c = pd.Series(closes)
    d = c.diff()
    rs = d.clip(lower=0).ewm(com=13, min_periods=14).mean() / (-d.clip(upper=0)).ewm(com=13, min_periods=14).mean()
    assert np.allclose(got["rsi_14"], (100 - 100 / (1 + rs)).fillna(50), rtol=1e-9)
    assert np.allclose(got["vol_20d"], (c.pct_change().rolling(20).std() * math.sqrt(252)).fillna(0.2), rtol=1e-9)
    assert np.allclose(got["sma_50_dist"], (c / c.rolling(50).mean() - 1).fillna(0), atol=1e-12)
    b = bench.orderBy("bar").toPandas()["bclose"].pct_change()
    beta = (c.pct_change().rolling(60).cov(b) / b.rolling(60).var()).clip(0.2, 3).fillna(1)
    assert np.allclose(got["beta_nifty"], beta, rtol=1e-8)


def test_an_up_trend_has_neutral_strength_and_short_history_has_defaults(spark):
    got = features.feature_panel(panel_of(spark, range(1, 40)), panel_of(spark, range(1, 40)).select("bar", F.col("close").alias("bclose"))).toPandas()
    assert (got["rsi_14"] == 50).all() and (got["sma_50_dist"] == 0).all() and not got[list(features.DEFAULTS)].isna().any().any()


def test_no_feature_sees_the_future(spark):
    closes = walk(90)
    changed = closes[:60] + [999_999.0] * 30
    bench = panel_of(spark, walk(90, 5)).select("bar", F.col("close").alias("bclose"))
    until = F.lit(dt.date(2020, 1, 1) + dt.timedelta(days=59))
    before, after = (features.feature_panel(panel_of(spark, x), bench).drop("rn") for x in (closes, changed))
    assert labels.leaks(before, after, until).count() == 0


def test_last_label_is_unknown_and_costs_add_up(spark):
    got = labels.forward_labels(panel_of(spark, [100, 101, 105, 95, 110])).orderBy("bar").collect()
    assert got[-1].target_1d is None and got[0].target_1d == 1.0 and got[2].target_1d == 0.0 and got[0].gross_1d == pytest.approx(0.01)
    assert [round(labels.round_trip_cost(k), 8) for k in labels.COST_REGIMES] == [0.0018588, 0.00294142, 0.00441342]


def test_barriers_stop_first_and_both_sides(spark):
    panel = panel_of(spark, [100, 100, 100, 100])  # each bar reaches from 98 to 101
    df = outcomes.with_path(panel).withColumns({"h": F.lit(2), "side": F.lit("LONG"), "stop": F.lit(98.5), "target": F.lit(100.5)})
    first = outcomes.path_outcomes(df).orderBy("bar").collect()
    assert len(first) == 2 and first[0].exit_reason == "STOP_LOSS" and first[0].exit_price == 98.5
    short = outcomes.path_outcomes(df.withColumns({"side": F.lit("SHORT"), "stop": F.lit(200.0), "target": F.lit(98.5)})).orderBy("bar").first()
    assert short.exit_reason == "TARGET_PROFIT" and short.gross == pytest.approx(0.015)
    late = outcomes.path_outcomes(df.withColumns({"stop": F.lit(1.0), "target": F.lit(900.0)})).orderBy("bar").first()
    assert late.exit_reason == "HORIZON_EXPIRY" and late.net < late.gross


def test_metrics_equal_plain_sums(spark):
    rng = np.random.default_rng(12)
    rets = [round(float(x), 4) for x in rng.normal(0.002, 0.03, 400)]
    rows = [("k", k // 7, k, r, r - 0.001, "TARGET_PROFIT" if r > 0.02 else "HORIZON_EXPIRY") for k, r in enumerate(rets)]
    trades = spark.createDataFrame(rows, "key string, day int, t int, gross double, net double, exit_reason string").repartition(5)
    net = np.array([r[4] for r in rows])
    m = outcomes.trade_metrics(trades, ["key"]).first()
    assert m.profit_factor == pytest.approx(net[net > 0].sum() / -net[net <= 0].sum()) and m.win_rate == pytest.approx(100 * np.mean([r > 0 for r in rets]))
    curve = outcomes.equity_curve(trades, ["key"], ["day", "t"], 0.5).orderBy("t").toPandas()
    equity = 100 * np.cumprod(1 + 0.5 * net)
    assert np.allclose(curve["equity"], equity) and np.allclose(curve["drawdown"], equity / np.maximum(np.maximum.accumulate(equity), 100) - 1)
    lost = spark.createDataFrame([("k", 1, 1, -2.0), ("k", 2, 2, 0.1)], "key string, day int, t int, net double")
    assert outcomes.equity_curve(lost, ["key"], ["day", "t"]).agg(F.max("equity")).first()[0] < 1e-5
    pairs = [("k", p, float(y)) for p, y in ((0.9, 1), (0.7, 0), (0.7, 1), (0.35, 0), (0.1, 0))]
    df = spark.createDataFrame(pairs, "key string, prob double, outcome double")
    assert outcomes.calibration_metrics(df, ["key"]).first().brier == pytest.approx(sum((p - y) ** 2 for _, p, y in pairs) / 5)
    # of the six pairs of one above and one below, five and a half are in order
    assert outcomes.auc(df, ["key"]).first().auc == pytest.approx(5.5 / 6)


def test_equal_count_bins_from_counts_equal_plain_ranks(spark):
    rng = np.random.default_rng(3)
    rows = [("5d", round(float(p), 1), float(rng.random() < p)) for p in rng.random(203)]
    got = outcomes.fit_binned_isotonic(spark.createDataFrame(rows, "horizon string, prob double, outcome double").repartition(4)).orderBy("x").collect()
    ranked, size = sorted((p, y) for _, p, y in rows), 203 // 8
    bins = [ranked[k * size : (k + 1) * size if k < 7 else None] for k in range(8)]
    blocks = [[sum(y for _, y in b), len(b), sum(p for p, _ in b)] for b in bins]
    k = 0
    while k + 1 < len(blocks):  # pool neighbours that fall
        if blocks[k][0] / blocks[k][1] > blocks[k + 1][0] / blocks[k + 1][1] + 1e-12:
            blocks[k : k + 2] = [[x + y for x, y in zip(blocks[k], blocks[k + 1], strict=True)]]
            k = max(0, k - 1)
        else:
            k += 1
    want = [(round(min(0.95, max(0.05, sp / n)), 3), round(min(0.92, max(0.08, sy / n)), 3)) for sy, n, sp in blocks]
    inner = [(r.x, r.y) for r in got if r.n > 0]
    assert len({y for _, y in inner}) == len({y for _, y in want}) and all(any(abs(x - u) < 2e-3 and abs(y - v) < 2e-3 for u, v in want) for x, y in inner)


def test_trimmed_means_equal_plain_ranks(spark):
    rng = np.random.default_rng(5)
    rows = [("5d", round(float(p), 3), float(r)) for p, r in zip(rng.random(500), rng.normal(0.001, 0.02, 500), strict=True)]
    got = outcomes.fit_buckets(spark.createDataFrame(rows, "horizon string, prob double, ret double").repartition(3)).where("kind = 'HORIZON_WIDE'").first()
    for side, value in ((sorted(r for *_, r in rows if r > 0), got.gain), (sorted(-r for *_, r in rows if r <= 0), got.loss)):
        cut = int(len(side) * 0.1)
        assert value == pytest.approx(np.mean(side[cut : len(side) - cut]), abs=6e-5)


def test_knots_are_monotone_and_extremes_are_pulled_in(spark):
    rows = [("5d", 0.15 + 0.8 * k / 19, float(k >= 8)) for k in range(20)]
    knots = outcomes.fit_binned_isotonic(spark.createDataFrame(rows, "horizon string, prob double, outcome double")).orderBy("x").collect()
    ys = [k.y for k in knots]
    assert ys == sorted(ys) and all(0.05 <= y <= 0.95 for y in ys) and len(knots) >= 2
    df = spark.createDataFrame([("5d", p / 10) for p in range(11)], "horizon string, prob double")
    table = spark.createDataFrame([(k.horizon, k.x, k.y) for k in knots], "horizon string, x double, y double")
    got = [r.calibrated for r in joins.calibrate(df, table).orderBy("prob").collect()]
    same = [r[0] for r in df.orderBy("prob").select(joins.interpolate(F.col("prob"), [(k.x, k.y) for k in knots])).collect()]
    assert got == sorted(got) and np.allclose(got, same)


def test_isotonic_grid(spark):
    rows = [(h, 0.1 + 0.8 * k / 99, float(k >= 40)) for h in ("1d", "5d", "20d") for k in range(100)]
    got = models.isotonic_knots(spark.createDataFrame(rows, "horizon string, prob double, outcome double")).where("horizon = '5d'").orderBy("x").collect()
    assert [r.y for r in got] == sorted(r.y for r in got) and len(got) == 10


def test_isotonic_knots_compute_their_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def looked_at(p):
        seen.add(1)
        return p

    rows = [(h, round(0.1 + 0.8 * (k % 25) / 24, 3), float(k % 25 >= 10)) for h in ("1d", "5d", "20d") for k in range(500)]
    df = spark.createDataFrame(rows, "horizon string, prob double, outcome double").repartition(3)
    got = models.isotonic_knots(df.withColumn("prob", F.udf(looked_at, "double")("prob"))).where("horizon = '5d'").orderBy("x").collect()
    assert seen.value == len(rows)
    assert [r.support for r in got] == [sum(abs(p - r.x) <= 0.08 for h, p, _ in rows if h == "5d") for r in got]
    assert [r.y for r in got] == [0.05 if r.x < 0.4 else 0.95 for r in got]


def test_cleaning_small_cases(spark):
    raw = [("A", "2020-01-02", "1.005", "2", "1", "1.5", "5", 2), ("A", "2020-01-02", "9", "9", "9", "9", "5", 3), ("A", "2020-01-03", "x", "2", "1", "1.5", "5", 4), ("A", "2020-01-04", "1", "0.5", "1", "1.5", "5", 5)]
    df = spark.createDataFrame(raw, "symbol string, time string, open string, high string, low string, close string, volume string, seq int")
    got = cleaning.clean_candles(df, ["symbol", "time"], "seq").collect()
    assert len(got) == 1 and got[0].open == 1.01 and got[0].volume == 5.0
    t = spark.createDataFrame([(" infy ",), ("^NSEI",), ("x.bo",)], "t string").select(cleaning.normalize_ticker(F.col("t")).alias("t")).collect()
    assert [r.t for r in t] == ["INFY.NS", "^NSEI", "X.BO"]
    times = spark.createDataFrame([(dt.datetime(2024, 1, 1, 3, 35),), (dt.datetime(2024, 1, 1, 5, 0),), (dt.datetime(2024, 1, 1, 11, 0),), (dt.datetime(2024, 1, 6, 5, 0),)], "t timestamp")
    assert [r.s for r in times.select(cleaning.session_status(F.col("t")).alias("s")).collect()] == ["PRE_OPEN", "OPEN", "CLOSED", "CLOSED"]


def replayed(orders, cash=1_000_000.0):
    """Cash, holdings and counts by a plain loop over (symbol, side, qty, price)."""
    held, counts = {}, [0, 0]
    for symbol, side, qty, price in orders:
        have, average = held.get(symbol, (0, 0.0))
        cost = round(qty * price, 2)
        if qty <= 0 or (cost > cash if side == "BUY" else qty > have):
            counts[1] += 1
        elif side == "BUY":
            held[symbol] = (have + qty, round((have * average + cost) / (have + qty), 2))
            cash, counts[0] = round(cash - cost, 2), counts[0] + 1
        else:
            held[symbol] = (have - qty, average)
            cash, counts[0] = round(cash + cost, 2), counts[0] + 1
    return cash, {s: x for s, x in held.items() if x[0]}, counts


def test_replay_equals_a_plain_loop(spark):
    rng = np.random.default_rng(8)
    orders = [(int(rng.integers(1, 4)), "XYZ"[rng.integers(0, 3)], k // 2, ["BUY", "SELL"][rng.integers(0, 2)], int(rng.integers(-2, 900)), round(float(rng.random() * 900 + 1), 2), k) for k in range(300)]
    ledger = spark.createDataFrame(orders, "portfolio long, symbol string, ts long, side string, qty int, price double, seq int")
    got = portfolio.replay(ledger.withColumn("seq", F.struct(F.lpad(F.col("seq").cast("string"), 5, "0").alias("k"))).repartition(4)).collect()
    for p in (1, 2, 3):
        cash, held, counts = replayed([(o[1], o[3], o[4], o[5]) for o in sorted(orders, key=lambda o: (o[2], o[6])) if o[0] == p])
        own = [r for r in got if r.portfolio == p]
        assert counts[1] > 0 and all((r.cash, r.accepted, r.rejected) == (cash, *counts) for r in own) and {r.symbol: (r.qty, r.average) for r in own if r.symbol} == held


def test_recurrences_over_many_chunks(spark, monkeypatch):
    closes = walk(900)
    for widest in (300, 50):  # chunks of 739 rows and of 123 for the fast mean; the slow one has a longer chunk of its own
        monkeypatch.setattr(recurrence, "WIDEST", widest)
        df = recurrence.numbered(panel_of(spark, closes))
        got = recurrence.ema(df, {"fast": ("close", 2 / 6), "slow": ("close", 2 / 401)}).orderBy("bar").toPandas()
        for name, span in (("fast", 5), ("slow", 400)):
            assert np.allclose(got[name], pd.Series(closes).ewm(span=span, adjust=False).mean(), rtol=1e-9)


def test_journal_and_alerts(spark):
    rows = [(1, "Axe", dt.datetime(2024, 1, d), side, q, p) for d, side, q, p in ((1, "BUY", 3, 10.0), (3, "SELL", 1, 90.0), (2, "BUY", 2, 20.0))] + [(2, "Bow", dt.datetime(2024, 1, 9), "BUY", 1, 1.0)]
    trades = spark.createDataFrame(rows, "portfolio long, symbol string, ts timestamp, side string, qty int, price double")
    universe = spark.createDataFrame([("Axe", "iron works"), ("Bow", "wood")], "symbol string, name string")

    def seen(**how):
        return [(r.symbol, r.ts.day) for r in portfolio.journal(trades, universe, **how).collect()]

    assert seen() == [("Bow", 9), ("Axe", 3), ("Axe", 2), ("Axe", 1)] and seen(text="IRON", order="oldest") == [("Axe", 1), ("Axe", 2), ("Axe", 3)]
    assert seen(text="axe", order="highest_value") == [("Axe", 3), ("Axe", 2), ("Axe", 1)] and seen(side="SELL") == [("Axe", 3)] and seen(text="none") == []
    alerts = spark.createDataFrame(
        [(1, "Axe", 5.0, "GREATER_THAN", 1, True), (1, "Bow", 6.0, "LESS_THAN", 2, True), (1, "Axe", 7.0, "LESS_THAN", 3, False)], "user long, symbol string, level double, condition string, created int, active boolean"
    )
    assert [(r.symbol, r.condition, r.place) for r in portfolio.user_alerts(alerts).orderBy("place").collect()] == [("Bow", "BELOW", 1), ("Axe", "ABOVE", 2)]


def test_names_in_blocks_find_the_same(spark, monkeypatch):
    texts = spark.createDataFrame([(k, f"news of firm{k % 7} and more") for k in range(40)], "id long, title string")
    universe = spark.createDataFrame([(k, f"firm{k}", f"name{k} x", "none") for k in range(7)], "rank int, symbol string, name string, sector string")
    want = sorted((r.id, r.affected) for r in joins.tag_headlines(texts, universe).collect())
    monkeypatch.setattr(joins, "NAMES", 2)
    assert sorted((r.id, r.affected) for r in joins.tag_headlines(texts, universe).collect()) == want and want[3] == (3, "firm3")


def test_predictions_are_stored_and_resolved(spark, tmp_path):
    panel = panel_of(spark, [100, 110, 90, 95, 96])
    made = panel.select("symbol", "bar", F.lit("1d").alias("horizon"), F.lit(0.6).alias("prob"))
    files.write_predictions(made, str(tmp_path / "p"))
    got = files.resolve_predictions(spark.read.parquet(str(tmp_path / "p")), panel, {"1d": 1, "5d": 5}).orderBy("bar").collect()
    assert [r.correct for r in got] == [1, 0, 1, 1, None] and got[0].actual_return == pytest.approx(0.1) and got[0].resolved_at == dt.date(2020, 1, 2)


def test_linear_scores(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, float("nan")), (1000.0, 0.0)], "rsi_14 double, macd_hist double")
    weights = spark.createDataFrame([("rsi_14", 1.0, 2.0, 0.5), ("macd_hist", 0.0, 0.0, 9.0)], "input string, mean double, std double, weight double")
    assert [r.prob for r in models.score_logistic(df, weights).orderBy("rsi_14").collect()] == [0.5, round(1 / (1 + math.exp(-0.5)), 4), 0.95]


def labelled_frame(spark, symbols=6, n=260):
    """Weekly rows whose label follows one input."""
    rng = np.random.default_rng(9)
    rows = []
    for s in range(symbols):
        for k in range(n):
            x = {c: float(rng.normal()) for c in models.INPUTS}
            rows.append((f"s{s}", dt.date(2018, 1, 1) + dt.timedelta(weeks=k), *x.values(), float(x["rsi_14"] + 0.3 * rng.normal() > 0)))
    return spark.createDataFrame(rows, "symbol string, bar date, " + ", ".join(f"{c} double" for c in models.INPUTS) + ", label double")


def test_models_learn_what_decides_and_are_measured_out_of_sample(spark):
    frame = labelled_frame(spark)
    weights = {r.input: r.weight for r in models.logistic_weights(frame).collect()}
    assert max(weights, key=lambda c: abs(weights[c])) == "rsi_14" and set(weights) == {"intercept", *models.INPUTS}
    panel = frame.select("symbol", "bar")
    made = models.fold_predictions(frame, panel, 3)
    folds = models.walk_forward(made).collect()
    assert len(folds) == 4 and all(r.auc > 0.9 and r.accuracy > 0.8 and r.n >= 100 for r in folds)
    assert {r.role for r in made.select("role").distinct().collect()} == {"VALIDATION", "TEST"} and made.where("prob < 0.05 OR prob > 0.95").count() == 0
    model, held = models.final_fit_holdout(frame, panel, 3)
    row = held.first()
    last = frame.agg(F.max("bar")).first()[0]
    assert row.auc > 0.9 and row.win_rate > 80 and row.last == last and row.first >= last - dt.timedelta(days=190) and model.getNumTrees >= 1


def test_too_few_rows_for_knots(spark):
    rows = [("5d", k / 40, float(k > 20)) for k in range(40)] + [("1d", 0.5, 1.0)] * 3
    got = models.isotonic_knots(spark.createDataFrame(rows, "horizon string, prob double, outcome double"))
    assert [(r.status, r.support) for r in got.where("horizon = '1d'").collect()] == [("INSUFFICIENT_DATA", 3)] and got.where("horizon = '5d' AND status = 'OK'").count() == 10


def test_scores_of_a_row_worked_out_apart(spark):
    """Probabilities, risk and decision of rows by plain arithmetic, written down apart from the library's expressions."""
    rng = np.random.default_rng(17)
    names = [*features.DEFAULTS]
    rows = []
    for k in range(40):
        f = {c: float(rng.normal(0, 0.05)) for c in names} | {"rsi_14": float(rng.uniform(10, 90)), "annualized_volatility": float(rng.uniform(0.1, 0.6)), "downside_deviation": float(rng.uniform(0.05, 0.5)), "beta_nifty": float(rng.uniform(0.3, 2.5)), "atr_percent": float(rng.uniform(0.01, 0.06)), "volume_z_score": float(rng.normal())}
        f |= {"close": 100.0 + k, "volume": 1e5, "atr_14": 1.0 + k / 10, "max_drawdown_60d": float(rng.uniform(0.01, 0.4)), "gap_risk": 0.01, "tail_risk_5pct": -0.03, "liquidity_score": 7.5}
        rows.append((f"s{k}", k, 99, *f.values(), None, "BULL_TREND"))
    order = [*f]
    df = spark.createDataFrame(rows, "symbol string, bar int, rn int, " + ", ".join(f"{c} double" for c in order) + ", news_sentiment double, regime string")
    got = {r.symbol: r for r in scoring.decide(scoring.risk(scoring.score(df))).collect()}
    for row in rows:
        f, r = dict(zip(order, row[3:], strict=False)), got[row[0]]
        parts = [(f["momentum_5"] / 0.05, 18), (f["momentum_20"] / 0.05, 12), (f["sma_50_dist"] / 0.06, 16), ((f["rsi_14"] - 50) / 25, 12), (f["macd_hist"] / 0.02, 14), (f["volume_z_score"] / 2, 8), (f["relative_strength_nifty"] / 0.04, 12)]
        raw = sum(min(2.5, max(-2.5, x)) * w for x, w in parts) / sum(w for _, w in parts)
        p5, p20 = (min(0.95, max(0.05, 1 / (1 + math.exp(-raw * scale)))) for scale in (1.0, 1.35))
        assert r.prob_5d == pytest.approx(p5, abs=6e-5) and r.prob_20d == pytest.approx(p20, abs=6e-5)
        stop, target = f["close"] - 2 * f["atr_14"], f["close"] + 3 * f["atr_14"]
        assert r.stop_loss == pytest.approx(stop, abs=6e-3) and r.target == pytest.approx(target, abs=6e-3)
        risk = 18 * min(1, f["annualized_volatility"] / 0.5) + 18 * min(1, f["downside_deviation"] / 0.35) + 15 * min(1, f["max_drawdown_60d"] / 0.25)
        risk += 12 * min(1, max(0, (f["beta_nifty"] - 0.5) / 1.5)) + 12 * min(1, f["atr_percent"] / 0.05) + 8 * 0.5 + 10 * 0.375 + 7 * (1 / 3)
        score = min(100, max(0, 0.6 * risk + 40 * r.downside))
        assert abs(r.risk_score - score) <= 0.51
        state = "EXIT" if r.risk_score >= 85 else "HIGH_RISK" if r.risk_score >= 65 else "CAUTION" if r.risk_score >= 45 else "NORMAL"
        assert r.risk_state == state
        sure = p20 >= 0.58 or p20 <= 0.42
        d, p = r.downside, r.prob_20d
        want = "NO_TRADE" if not sure else "STRONG_SELL" if d >= 0.75 or p <= 0.26 else "SELL" if d >= 0.6 or p <= 0.38 else "REDUCE" if d >= 0.5 or p <= 0.46 else "ACCUMULATE" if p >= 0.54 else "HOLD"
        assert r.decision == want  # the reward to risk of 1.5 is under both hurdles


def test_decisions_and_levels(spark):
    base = dict.fromkeys([*features.DEFAULTS], 0.0) | {"rsi_14": 80.0, "momentum_5": 0.2, "momentum_20": 0.2, "sma_50_dist": 0.2, "macd_hist": 0.1, "relative_strength_nifty": 0.2, "volume_z_score": 2.0}
    row = {"symbol": "A", "bar": 1, "rn": 99, "close": 100.0, "volume": 1e6, "atr_14": 2.0, "max_drawdown_60d": 0.05, "gap_risk": 0.01, "tail_risk_5pct": -0.02, "liquidity_score": 8.0, "news_sentiment": None, "regime": "BULL_TREND", **base}
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) else 'int' if isinstance(v, int) else 'double'}" for k, v in row.items())
    df = spark.createDataFrame([tuple(row.values())], schema)
    out = scoring.decide(scoring.risk(scoring.score(df)), 1.4, 1.5).first()
    assert out.stop_loss == 96 and out.target == 106 and out.reward_risk == 1.5 and out.prob_20d == 0.95 and out.decision == "STRONG_BUY" and 0.02 <= out.weight <= 0.15
    panic = scoring.decide(scoring.risk(scoring.score(df.withColumn("regime", F.lit("PANIC"))))).first()
    assert panic.decision == "HOLD" and panic.risk_state in ("NORMAL", "CAUTION")


def test_headlines(spark):
    rows = [(1, "RBI holds repo rate - Daily - Mint", "x", "https://a/b"), (2, "Shares surge on record profit", "y", "https://a/c"), (3, "Fraud probe and crash", "z", "u")]
    got = news.classify(spark.createDataFrame(rows, "id long, title string, source string, url string")).orderBy("id").collect()
    assert (got[0].title, got[0].source, got[0].category, got[0].impact) == ("RBI holds repo rate - Daily", "Mint", "Macro", "HIGH")
    assert got[1].sentiment == "POSITIVE" and got[2].sentiment == "NEGATIVE" and got[0].article_id == "news_aHR0cHM6Ly9hL2I="


def test_money(spark):
    df = spark.createDataFrame([(3, 10.005, 110.0, 100.0)], "q int, p double, c double, i double")
    row = df.select(columns.money_times(F.col("q"), F.col("p")), columns.return_percent(F.col("c"), F.col("i")), columns.new_average(F.lit(10), F.lit(100.0), F.lit(10), F.lit(110.0))).first()
    assert float(row[0]) == 30.03 and row[1] == 10.0 and float(row[2]) == 105.0


def test_files(spark, tmp_path):
    panel = panel_of(spark, walk(250))
    files.write_bars(panel.where("bar < DATE '2020-06-01'"), str(tmp_path / "b"))
    files.append_bars(panel, str(tmp_path / "b"))
    assert files.scan_bars(spark, str(tmp_path / "b")).count() == 250 and files.scan_bars(spark, str(tmp_path / "b"), excluded=["A"]).count() == 0
    panel.write.parquet(str(tmp_path / "s"))
    doc = {"version": "1", "calibrationKnots": [[0.1, 0.2], [0.9, 0.8]], "empiricalDistributions": [{"horizon": "5d", "probLower": 0, "probUpper": 1, "bucketType": "BROAD", "meanGainConditionalUp": 0.1, "meanLossConditionalDown": 0.1, "sampleCount": 5}]}
    (tmp_path / "m.json").write_text(json.dumps(doc, indent=1))
    knots, buckets = files.scan_manifests(spark, str(tmp_path / "m.json"))
    assert [(k.x, k.y) for k in knots.orderBy("place").collect()] == [(0.1, 0.2), (0.9, 0.8)] and buckets.first().bucketType == "BROAD"
    files.export_ledger(spark.createDataFrame([("A \"x\"", dt.datetime(2024, 1, 1, 5, 0))], "symbol string, ts timestamp"), str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first()
    assert back.symbol == 'A "x"' and back.local_time == "2024-01-01 10:30:00"


def test_outside_models(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "x double, k string")
    assert [r.prob for r in models.score_external(df, lambda pdf: pdf["x"] / 4, ["x"]).orderBy("x").collect()] == [0.25, 0.5]
