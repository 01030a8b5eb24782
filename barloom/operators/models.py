"""Models on features: logistic regression, boosted trees by walk-forward folds, isotonic knots, and outside models."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.columns import clamp, finite, sigmoid
from barloom.operators import labels, outcomes
from barloom.operators.features import DEFAULTS, feature_panel
from barloom.sources import tables
from barloom.sources.shared import shared_path

INPUTS = [c for c in DEFAULTS if c not in ("annualized_volatility", "momentum_5", "momentum_20")]


def training_frame(spark: SparkSession, sf_dir: str, horizon: str = "5d") -> DataFrame:
    panel = tables.bars(spark, sf_dir)
    df = labels.forward_labels(feature_panel(panel, tables.benchmark(panel)))
    return df.select("symbol", "bar", *INPUTS, F.col(f"target_{horizon}").alias("label")).where("label IS NOT NULL")


def logistic_weights(frame: DataFrame) -> DataFrame:
    """Weights of a standardised, L2-regularised logistic regression, one row per input. They are as many as the inputs."""
    steps = [VectorAssembler(inputCols=INPUTS, outputCol="_v"), StandardScaler(inputCol="_v", outputCol="v", withMean=True), LogisticRegression(featuresCol="v", regParam=0.01)]
    model = Pipeline(stages=steps).fit(frame.cache())
    frame.unpersist()
    rows = [("intercept", float(model.stages[-1].intercept)), *zip(INPUTS, map(float, model.stages[-1].coefficients), strict=True)]
    return frame.sparkSession.createDataFrame(rows, "input string, weight double")


def clean_inputs(df: DataFrame, neutral: dict[str, float], probabilities: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with inputs that a model takes: null, NaN and infinite values become the input's ``neutral`` one, and probabilities lie within 0.05 and 0.95.

    An unknown probability is one half.
    """
    cleaned = {c: F.coalesce(finite(F.col(c)), F.lit(float(x))) for c, x in neutral.items()}
    bounded = {c: clamp(F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(0.5)), 0.05, 0.95) for c in probabilities}
    return df.withColumns(cleaned | bounded)


def trade_samples(parted: DataFrame, columns: list[str], ahead: str = "gross_5d") -> DataFrame:
    """What a learned score is fitted on: bars of the training partition (``partition``) with whether the price rose over the next five bars."""
    rows = parted.where((F.col("partition") == "TRAIN") & F.col(ahead).isNotNull())
    return rows.select("symbol", "bar", *columns, (F.col(ahead) > 0).cast("double").alias("outcome"))


#: Rows that a learned score needs.
ENOUGH = 20


def sample_statistics(samples: DataFrame, columns: list[str]) -> DataFrame:
    """(input, n, mean, std): of the known values of each input, the deviation that of all of them (1 where it is 0), from one aggregation."""
    known = {c: F.when(F.col(c).isNotNull() & ~F.isnan(c), F.col(c)) for c in columns}
    of = [F.struct(F.lit(c).alias("input"), F.count(x).alias("n"), F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"), F.coalesce(F.nullif(F.stddev_pop(x), F.lit(0.0)), F.lit(1.0)).alias("std")) for c, x in known.items()]
    return samples.agg(F.array(*of).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def fit_linear(samples: DataFrame, columns: list[str], strength: float = 0.01) -> DataFrame | None:
    """The table of :func:`score_logistic` (input, mean, std, weight; ``intercept`` has weight and mean 0, std 1) fitted on ``outcome``; None with under ``ENOUGH`` rows.

    Unknown inputs count as their mean, inputs are standardised, weights are held back by ``strength``. The fit goes on to the optimum.
    """
    table = sample_statistics(samples, columns).collect()  # a row per input
    if samples.count() < ENOUGH:
        return None
    standard = [((F.coalesce(F.when(~F.isnan(r.input), F.col(r.input)), F.lit(r.mean)) - r.mean) / r.std).alias(r.input) for r in table]
    rows = VectorAssembler(inputCols=columns, outputCol="v").transform(samples.select(*standard, "outcome")).select("v", "outcome").cache()
    model = LogisticRegression(featuresCol="v", labelCol="outcome", regParam=strength, standardization=False, tol=1e-9, maxIter=200).fit(rows)
    rows.unpersist()
    told = [("intercept", 0.0, 1.0, float(model.intercept)), *[(r.input, r.mean, r.std, float(w)) for r, w in zip(table, model.coefficients, strict=True)]]
    return samples.sparkSession.createDataFrame(told, "input string, mean double, std double, weight double")


def at_once(spark: SparkSession, tasks: list[Callable[[], object]], most: int = 4) -> list:
    """The results of ``tasks`` that each run Spark jobs, up to ``most`` of them at the same time; Spark shares its executors among them."""
    with ThreadPoolExecutor(most) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(t)) for t in tasks]]


#: The inputs of the linear score.
LINEAR = [
    "rsi_14", "macd_hist", "sma_20_dist", "sma_50_dist", "ema_20_dist", "atr_percent", "bb_width", "stoch_k", "volume_z_score", "annualized_volatility",
    "downside_deviation", "beta_nifty", "relative_strength_nifty", "momentum_5", "momentum_20",
]


def score_logistic(df: DataFrame, weights: DataFrame, bias: float = 0.0, out: str = "prob") -> DataFrame:
    """``df`` with a probability by ``weights`` (input, mean, std, weight; a row per input): a standardised dot product through a sigmoid, clamped.

    An unknown input counts as its mean.
    """
    z = F.lit(bias)
    for r in weights.orderBy("input").collect():
        x = F.when(F.col(r.input).isNull() | F.isnan(r.input), F.lit(r.mean)).otherwise(F.col(r.input))
        z = z + (x - F.lit(r.mean)) / F.lit(r.std or 1.0) * F.lit(r.weight or 0.0)
    return df.withColumn(out, F.round(clamp(sigmoid(clamp(z, -10, 10)), 0.05, 0.95).cast("decimal(20,10)"), 4).cast("double"))


def linear_weights(frame: DataFrame) -> DataFrame:
    """A weight per input, its correlation with the label: a plain linear score's table, from one aggregation."""
    of = [F.struct(F.lit(c).alias("input"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.corr(c, "label").alias("weight")) for c in LINEAR]
    return frame.agg(F.array(*of).alias("w")).select(F.explode("w").alias("w")).select("w.*")


def with_vector(frame: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=INPUTS, outputCol="features").transform(frame).select("symbol", "bar", "features", "label")


def score_model(model, rows: DataFrame) -> DataFrame:
    """Probabilities of a fitted model, clamped and to four decimals; ``label`` becomes ``outcome``."""
    p = F.get(vector_to_array("probability"), F.lit(1))
    return model.transform(rows).withColumn("prob", F.round(clamp(p, 0.05, 0.95), 4)).withColumnRenamed("label", "outcome")


def fold_predictions(frame: DataFrame, panel: DataFrame, rounds: int = 5) -> DataFrame | None:
    """Boosted trees by fold, fitted on training rows and stopped by validation rows: predictions of validation and test rows.

    Folds without 50 training, 20 validation and 20 test rows are left out. Several folds are fitted at once over one cached frame, each fit is distributed.
    """
    spark = frame.sparkSession
    frame = with_vector(frame).cache()
    schema = labels.make_folds(panel).schema

    def fit(fold) -> DataFrame | None:
        rows = labels.assign_folds(frame, spark.createDataFrame([fold.asDict()], schema))
        sizes = {r.role: r["count"] for r in rows.groupBy("role").count().collect()}
        if all(sizes.get(role, 0) >= least for role, least in (("TRAIN", 50), ("VALIDATION", 20), ("TEST", 20))):
            fitted = rows.where("role <> 'TEST'").withColumn("held", F.col("role") == "VALIDATION")
            model = GBTClassifier(maxIter=rounds, maxDepth=3, validationIndicatorCol="held", seed=7).fit(fitted)
            return score_model(model, rows.where("role <> 'TRAIN'")).select(F.lit(fold["fold"]).alias("fold"), "role", "symbol", "bar", "prob", "outcome")
        return None

    out = [x for x in at_once(spark, [partial(fit, fold) for fold in labels.make_folds(panel).collect()]) if x is not None]
    done = staged(reduce(DataFrame.unionByName, out)) if out else None
    frame.unpersist()
    return done


def staged(df: DataFrame, label: str = "predictions") -> DataFrame:
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def walk_forward(predictions: DataFrame) -> DataFrame:
    """Test metrics by fold of :func:`fold_predictions`."""
    tested = predictions.where("role = 'TEST'")
    metrics = outcomes.calibration_metrics(tested, ["fold"]).select("fold", "n", "brier", "ece")
    return metrics.join(outcomes.auc(tested, ["fold"]).select("fold", "auc", "accuracy"), "fold")


def final_fit_holdout(frame: DataFrame, panel: DataFrame, rounds: int = 5, holdout: int = 6) -> tuple[object, DataFrame]:
    """The model fitted on all rows before the last ``holdout`` months of ``panel``, and its metrics on the rows after (one row)."""
    start = panel.agg(F.add_months(F.max("bar"), -holdout)).first()[0]
    frame = with_vector(frame).cache()
    model = GBTClassifier(maxIter=rounds, maxDepth=3, seed=7).fit(frame.where(F.col("bar") < F.lit(start)))
    held = staged(score_model(model, frame.where(F.col("bar") >= F.lit(start))).select("bar", "prob", "outcome")).withColumn("model", F.lit("final"))
    frame.unpersist()
    right = (F.col("prob") > 0.5) == (F.col("outcome") == 1)
    sums = held.groupBy("model").agg(F.min("bar").alias("first"), F.max("bar").alias("last"), F.count("*").alias("n"), F.avg(F.pow(F.col("prob") - F.col("outcome"), 2)).alias("brier"), (F.avg(right.cast("double")) * 100).alias("win_rate"))
    return model, sums.join(outcomes.auc(held, ["model"]).select("model", "auc", "accuracy"), "model")


def isotonic_knots(scored: DataFrame, points: int = 10, least: int = 15, prior: int = 10, enough: int = 20) -> DataFrame:
    """Knots per horizon on a grid of probabilities: isotonic fits, pulled towards one half where few rows support them, non-decreasing.

    A horizon with under ``enough`` rows has no knots but one row that says so (``status``). ``scored`` is computed once: fits and supports are taken from its rows
    counted by probability and outcome, which are stored.
    """
    grid = [round(0.05 + 0.9 * k / (points - 1), 3) for k in range(points)]
    out = scored.sparkSession.createDataFrame([], "horizon string, x double, fit double, support bigint, status string")
    counts = staged(scored.groupBy("horizon", "prob", F.col("outcome").alias("label")).agg(F.count("*").alias("weight")), "isotonic-counts")
    sizes = {r.horizon: r["count"] for r in counts.groupBy("horizon").agg(F.sum("weight").alias("count")).collect()}
    for horizon in ("1d", "5d", "20d"):
        if sizes.get(horizon, 0) < enough:
            out = out.unionByName(scored.sparkSession.createDataFrame([(horizon, None, None, sizes.get(horizon, 0), "INSUFFICIENT_DATA")], out.schema))
            continue
        own = counts.where(F.col("horizon") == horizon).select("prob", "label", "weight")
        model = IsotonicRegression(featuresCol="prob", labelCol="label", weightCol="weight").fit(VectorAssembler(inputCols=["prob"], outputCol="v").transform(own).drop("prob").withColumnRenamed("v", "prob"))
        near = own.select("weight", F.explode(F.array(*[F.when(F.abs(F.col("prob") - x) <= 0.08, F.lit(x)) for x in grid])).alias("x")).where("x IS NOT NULL").groupBy("x").agg(F.sum("weight").alias("support"))
        fits = own.sparkSession.createDataFrame([(x, min(0.95, max(0.05, float(model.predict(x))))) for x in grid], "x double, fit double")
        knots = fits.join(near, "x", "left").select(F.lit(horizon).alias("horizon"), "x", "fit", F.coalesce("support", F.lit(0)).alias("support"), F.lit("OK").alias("status"))
        out = out.unionByName(knots)
    pulled = F.when(F.col("support") < least, (F.col("fit") * F.col("support") + 0.5 * prior) / (F.col("support") + prior)).otherwise(F.col("fit"))
    up = Window.partitionBy("horizon").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    return out.select("horizon", "x", F.max(F.round(pulled, 3)).over(up).alias("y"), "support", "status")


def score_external(df: DataFrame, model: Callable[[pd.DataFrame], pd.Series], columns: list[str], out: str = "prob") -> DataFrame:
    """``df`` with what an outside model makes of ``columns``, in Arrow batches on the executors."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{out: model(batch[columns]).astype("float64")})

    return df.mapInPandas(rows, f"{', '.join(f'`{c}` {kind}' for c, kind in df.dtypes)}, {out} double")
