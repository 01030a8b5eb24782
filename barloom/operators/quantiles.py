"""Quantiles from mergeable sketches: one small sketch per group and month, merged for any window of months, with a stated error of rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items that a sketch keeps at its top level; its size grows with the logarithm of what it has seen.
KEPT = 800


def rank_error(kept: int = KEPT) -> float:
    """The error of a single quantile's rank, as a share of all values, that is kept with a confidence of 99 percent (fixed values: the published fit)."""
    return 2.296 / kept**0.9723


def monthly(rows: DataFrame, keys: list[str], value: str, at: str, kept: int = KEPT) -> DataFrame:
    """A sketch of ``value`` by ``keys`` and month of ``at``: (keys, month, n, sketch). Tasks sketch their own rows before the shuffle."""
    month = F.trunc(at, "month").alias("month")
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, month).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(value, F.lit(kept)).alias("sketch"))


def windowed(sketches: DataFrame, keys: list[str], months: int) -> DataFrame:
    """Sketches of the ``months`` up to each month that has one: every month's sketch is merged into the windows that hold it, values aren't read again."""
    ends = sketches.select(*keys, F.col("month").alias("end"))
    reach = sketches.withColumn("end", F.explode(F.transform(F.sequence(F.lit(0), F.lit(months - 1)), lambda k: F.add_months("month", k))))
    return reach.join(ends, [*keys, "end"]).groupBy(*keys, F.col("end").alias("month")).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantile(sketch: str, rank: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(rank))


def exact(rows: DataFrame, keys: list[str], value: str, at: str, months: int, ranks: list[float]) -> DataFrame:
    """The exact quantiles of the same windows, the check of :func:`windowed`: all values of a window meet."""
    month = F.trunc(at, "month")
    ends = rows.where(F.col(value).isNotNull()).select(*keys, month.alias("month")).distinct()
    reach = rows.where(F.col(value).isNotNull()).select(*keys, value, F.explode(F.transform(F.sequence(F.lit(0), F.lit(months - 1)), lambda k: F.add_months(month, k))).alias("month"))
    return reach.join(ends, [*keys, "month"]).groupBy(*keys, "month").agg(F.percentile(value, F.array(*[F.lit(r) for r in ranks])).alias("exact"), F.count("*").alias("seen"))


def off_by(rows: DataFrame, told: DataFrame, keys: list[str], value: str, at: str, months: int, ranks: list[float]) -> DataFrame:
    """``told`` (keys, month, n, sketch) with ``error``: by how much of all values the true rank of a sketched quantile is off, at most over ``ranks``.

    A value's true rank is any between the shares of values under it and up to it.
    """
    found = told.select(*keys, "month", F.array(*[quantile("sketch", r) for r in ranks]).alias("q"))
    month = F.trunc(at, "month")
    reach = rows.where(F.col(value).isNotNull()).select(*keys, value, F.explode(F.transform(F.sequence(F.lit(0), F.lit(months - 1)), lambda k: F.add_months(month, k))).alias("month"))
    met = reach.join(found, [*keys, "month"])
    shares = [(F.avg((F.col(value) < F.get("q", F.lit(k))).cast("double")), F.avg((F.col(value) <= F.get("q", F.lit(k))).cast("double"))) for k in range(len(ranks))]
    errors = [F.greatest(under - r, r - upto, F.lit(0.0)) for (under, upto), r in zip(shares, ranks, strict=True)]
    return told.join(met.groupBy(*keys, "month").agg(F.greatest(*errors, F.lit(0.0)).alias("error")), [*keys, "month"])
