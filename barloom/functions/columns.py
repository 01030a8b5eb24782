"""Small column expressions: clamps, money, and rounding of results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.nullif(b, F.lit(0.0))


def or_else(x: Column, default: Column | float) -> Column:
    """``default`` where x is null or zero."""
    return F.coalesce(F.nullif(x, F.lit(0.0)), default if isinstance(default, Column) else F.lit(default))


def money(x: Column) -> Column:
    """Two decimals, halves away from zero; null counts as nothing."""
    return F.coalesce(x.cast("decimal(20,6)").cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))


def money_times(quantity: Column, price: Column) -> Column:
    return money(quantity.cast("decimal(12,0)") * price.cast("decimal(18,2)"))


def return_percent(current: Column, invested: Column) -> Column:
    return F.when(invested > 0, F.round((current - invested).cast("double") / invested.cast("double") * 100, 2)).otherwise(F.lit(0.0))


def new_average(held: Column, average: Column, bought: Column, price: Column) -> Column:
    """The average price after a buy, weighted by quantity."""
    total = held + bought
    return F.when(total > 0, ((held * average + bought * price) / total).cast("decimal(18,2)")).otherwise(F.lit(0).cast("decimal(18,2)"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once a row however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def finite(x: Column) -> Column:
    """Null for NaN and infinite values."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def layered(df: DataFrame, layers: list[dict[str, str]]) -> DataFrame:
    """``df`` with one level of SQL expressions after the other: each level may use the columns of those before."""
    for layer in layers:
        df = df.withColumns({c: F.expr(e) for c, e in layer.items()})
    return df


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """``df`` in the form in which results are compared: doubles to so many digits (zero has no sign), dates and times as text."""

    def shown(c: str, kind: str) -> Column:
        if kind == "double":
            return (F.round(c, digits) + 0.0).alias(c)
        return F.col(c).cast("string").alias(c) if kind in ("date", "timestamp", "timestamp_ntz") else F.col(c)

    return df.select(*[shown(c, kind) for c, kind in df.dtypes])
