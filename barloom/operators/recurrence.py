"""Exponentially weighted sums without Python: a linear recurrence over each symbol's rows.

Rows are cut into chunks. Within a chunk, the sum of x weighted by q ** -k is a running window sum, rescaled by q ** k; the last full chunk's
sum is carried on by a second running window. A chunk is so long that what earlier chunks leave is under a double's last digit; sums
whose q are too far apart for one length of chunk get their own. All windows share one clustering and order, nothing is joined, and the work is
linear in a symbol's rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Powers of q stay within exp(+-300), and what is under exp(-40) doesn't count.
WIDEST, LEAST = 300, 40


def numbered(df: DataFrame, symbol: str = "symbol", order: str = "bar") -> DataFrame:
    """``df`` with ``rn``, the row's place from 0."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(symbol).orderBy(order)) - 1)


def weighted_sums(df: DataFrame, sums: dict[str, tuple[str, float]], symbol: str = "symbol") -> DataFrame:
    """For each ``out: (column, q)``: out = column + q * (out of the row before). ``df`` has ``rn``; null values count as 0."""
    rates = {out: -math.log(q) for out, (_, q) in sums.items()}
    left = sorted(sums, key=rates.get, reverse=True)
    while left:
        chunk = max(2, int(WIDEST / rates[left[0]]))
        same = [out for out in left if out == left[0] or rates[out] * chunk >= LEAST]
        df = chunked_sums(df, {out: sums[out] for out in same}, symbol, chunk)
        left = [out for out in left if out not in same]
    return df


def chunked_sums(df: DataFrame, sums: dict[str, tuple[str, float]], symbol: str, chunk: int) -> DataFrame:
    number = (F.col("rn") / chunk).cast("int")
    df = df.withColumns({"_chunk": number, "_k": F.col("rn") - number * chunk})
    within = Window.partitionBy(symbol, "_chunk").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns(
        {f"_{out}": F.pow(F.lit(q), F.col("_k")) * F.sum(F.coalesce(F.col(c), F.lit(0.0)) * F.pow(F.lit(q), -F.col("_k"))).over(within) for out, (c, q) in sums.items()}
    )
    earlier = Window.partitionBy(symbol).orderBy("_chunk", "rn").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({f"_c_{out}": F.last(F.when(F.col("_k") == chunk - 1, F.col(f"_{out}")), ignorenulls=True).over(earlier) for out in sums})
    added = {out: F.col(f"_{out}") + F.coalesce(f"_c_{out}", F.lit(0.0)) * F.pow(F.lit(q), F.col("_k") + 1) for out, (_, q) in sums.items()}
    return df.withColumns(added).drop("_chunk", "_k", *[f"{p}{out}" for out in sums for p in ("_", "_c_")])


def ema(df: DataFrame, means: dict[str, tuple[str, float]], symbol: str = "symbol", first: int = 0) -> DataFrame:
    """Exponential means out = a * x + (1 - a) * before, seeded with the value of row ``first``; null before it."""
    seeded = {f"_x_{out}": F.when(F.col("rn") == first, F.col(c)).when(F.col("rn") > first, a * F.col(c)) for out, (c, a) in means.items()}
    out = weighted_sums(df.withColumns(seeded), {o: (f"_x_{o}", 1 - a) for o, (_, a) in means.items()}, symbol)
    return out.withColumns({o: F.when(F.col("rn") >= first, F.col(o)) for o in means}).drop(*seeded)


def wilder(df: DataFrame, means: dict[str, str], period: int, symbol: str = "symbol", first: int = 1, order: str = "bar") -> DataFrame:
    """Wilder's smoothing: the plain mean of the first ``period`` values (rows ``first`` on), then alpha = 1 / period."""
    start = first + period - 1
    w = Window.partitionBy(symbol).orderBy(order).rowsBetween(-(period - 1), 0)
    seeds = df.withColumns({f"_s_{out}": F.when(F.col("rn") == start, F.avg(c).over(w)).otherwise(F.col(c)) for out, c in means.items()})
    return ema(seeds, {out: (f"_s_{out}", 1 / period) for out in means}, symbol, start).drop(*[f"_s_{out}" for out in means])
