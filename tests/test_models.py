"""Samples, statistics and fits of the learned linear score against plain arithmetic; cleaned inputs; fits at once."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import models

INPUTS = ["a", "b", "c"]
SCHEMA = "symbol string, bar int, partition string, a double, b double, c double, gross_5d double"


def rows(n, seed=5):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        a, b = rng.gauss(3, 2), rng.gauss(-1, 0.5)
        rose = rng.random() < 1 / (1 + math.exp(-(a - 3) - 2 * (b + 1)))
        out.append(("S", k, rng.choice(["TRAIN", "TRAIN", "TEST"]), None if k % 11 == 0 else math.nan if k % 13 == 0 else a, b, 4.0, None if k % 17 == 0 else 0.1 if rose else -0.1))
    return out


def plain_optimum(samples, strength=0.01):
    """Intercept and weights that minimise the mean log loss and half the weights' squares, by Newton's steps."""
    x = np.array([[np.nan if v is None else v for v in r[3:6]] for r in samples], float)
    y = np.array([float(r[6] > 0) for r in samples])
    mean = np.nanmean(x, axis=0)
    std = np.where((s := np.nanstd(x, axis=0)) > 0, s, 1.0)
    z = np.hstack([np.ones((len(y), 1)), (np.where(np.isnan(x), mean, x) - mean) / std])
    w, pull = np.zeros(4), strength * np.array([0, 1, 1, 1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) / len(y) + np.diag(pull), z.T @ (p - y) / len(y) + pull * w)
    return mean, std, w


def test_fit_equals_the_plain_optimum(spark):
    data = rows(600)
    samples = models.trade_samples(spark.createDataFrame(data, SCHEMA).repartition(3), INPUTS)
    own = [r for r in data if r[2] == "TRAIN" and r[6] is not None]
    assert samples.count() == len(own) and samples.columns == ["symbol", "bar", *INPUTS, "outcome"]
    mean, std, want = plain_optimum(own)
    told = {r.input: r for r in models.sample_statistics(samples, INPUTS).collect()}
    assert np.allclose([told[c].mean for c in INPUTS], mean) and np.allclose([told[c].std for c in INPUTS], std)
    assert told["a"].n == sum(r[3] is not None and not math.isnan(r[3]) for r in own) and told["c"].std == 1.0
    fitted = models.fit_linear(samples, INPUTS)
    got = {r.input: r for r in fitted.collect()}
    assert np.allclose([got[c].weight for c in ("intercept", *INPUTS)], want, atol=1e-3) and abs(want[1]) > 0.5
    scored = models.score_logistic(spark.createDataFrame([(None, -1.0, 4.0)], "a double, b double, c double"), fitted.where("input <> 'intercept'"), got["intercept"].weight).first()
    z = want[0] + want[2] * (-1.0 - mean[1]) / std[1]
    assert scored.prob == pytest.approx(1 / (1 + math.exp(-z)), abs=2e-3)


def test_few_rows_are_not_fitted(spark):
    few = [r for r in rows(200) if r[2] == "TRAIN" and r[6] is not None][:19]
    assert models.fit_linear(models.trade_samples(spark.createDataFrame(few, SCHEMA), INPUTS), INPUTS) is None


def test_inputs_are_cleaned(spark):
    df = spark.createDataFrame([(None, math.inf, 1.45), (math.nan, -0.5, None), (30.0, -math.inf, -3.0), (70.0, 0.2, math.nan)], "rsi double, dist double, p double")
    got = [tuple(r) for r in models.clean_inputs(df, {"rsi": 50, "dist": 0}, ("p",)).collect()]
    assert got == [(50.0, 0.0, 0.95), (50.0, -0.5, 0.5), (30.0, 0.0, 0.05), (70.0, 0.2, 0.5)]


def test_fits_at_once_keep_their_order_and_their_errors(spark):
    def counted(n):
        return lambda: spark.range(n).agg(F.count("*")).first()[0]

    assert models.at_once(spark, [counted(n) for n in (5, 3, 8, 1, 2)], 3) == [5, 3, 8, 1, 2]
    with pytest.raises(ZeroDivisionError):
        models.at_once(spark, [counted(2), lambda: 1 / 0])
