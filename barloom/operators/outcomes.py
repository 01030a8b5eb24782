"""Which barrier a signal touches first, and the metrics of the trades that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from barloom.functions.columns import ratio
from barloom.operators.features import ws

#: Slippage, brokerage and tax on sells of the path form of costs.
SLIPPAGE, BROKERAGE, SELL_TAX = 0.0005, 0.0003, 0.0010


def signal_outcomes(signals: DataFrame, gross: str, vol: str, cost: float, threshold: float = 0.55) -> DataFrame:
    """Signals with a probability of ``threshold`` or more; the outcome is decided by the horizon's return, the stop first."""
    g, v = F.col(gross), F.col(vol)
    hit = F.when(g <= -1.5 * v, "STOP_LOSS").when(g >= 2.25 * v, "TARGET_HIT").otherwise("HORIZON_EXPIRY")
    active = signals.where((F.col("prob") >= threshold) & g.isNotNull()).withColumn("exit_reason", hit)
    got = F.when(F.col("exit_reason") == "STOP_LOSS", -1.5 * v).when(F.col("exit_reason") == "TARGET_HIT", 2.25 * v).otherwise(g)
    return active.withColumns({"exit_price": F.col("close") * (1 + got), "net": got - cost})


def with_path(panel: DataFrame, longest: int = 20) -> DataFrame:
    """Bars with the next ``longest`` bars of their symbol as an array (one shuffle, shared by all horizons)."""
    return panel.withColumn("path", F.collect_list(F.struct("bar", "high", "low", "close")).over(ws().rowsBetween(1, longest)))


def path_outcomes(signals: DataFrame) -> DataFrame:
    """Signals (close, side, stop, target, h, path) with the first barrier touched in the next h bars; the stop counts where one bar touches both.

    Signals without h bars after them are left out. Net returns bear slippage, brokerage and tax on each side.
    """
    long = F.col("side") == "LONG"
    path = F.slice("path", 1, F.col("h"))
    stopped = lambda p: (long & (p["low"] <= F.col("stop"))) | (~long & (p["high"] >= F.col("stop")))
    reached = lambda p: (long & (p["high"] >= F.col("target"))) | (~long & (p["low"] <= F.col("target")))
    touched = F.transform(path, lambda p: F.struct(p["bar"].alias("bar"), stopped(p).alias("stop"), reached(p).alias("target")))
    df = signals.where(F.size("path") >= F.col("h")).withColumn("_first", F.get(F.filter(touched, lambda t: t["stop"] | t["target"]), F.lit(0)))
    last = F.get("path", F.col("h") - 1)
    df = df.withColumns(
        {
            "exit_reason": F.when(F.col("_first.stop"), "STOP_LOSS").when(F.col("_first.target"), "TARGET_PROFIT").otherwise("HORIZON_EXPIRY"),
            "exit_bar": F.coalesce("_first.bar", last["bar"]),
            "_close": last["close"],
        }
    )
    return settled(df).drop("path", "_first", "_close")


def settled(df: DataFrame) -> DataFrame:
    """``exit_price``, ``gross`` and ``net`` of trades whose ``exit_reason`` and close at the horizon (``_close``) are known."""
    long = F.col("side") == "LONG"
    price = F.when(F.col("exit_reason") == "STOP_LOSS", F.col("stop")).when(F.col("exit_reason") == "TARGET_PROFIT", F.col("target")).otherwise(F.col("_close"))
    df = df.withColumn("exit_price", price)
    entry, out = F.col("close"), F.col("exit_price")
    gross = F.when(long, out / entry - 1).otherwise(1 - out / entry)
    buy, sell = 1 + SLIPPAGE + BROKERAGE, 1 - SLIPPAGE - BROKERAGE - SELL_TAX
    net = F.when(long, out * sell / (entry * buy) - 1).otherwise((entry * sell - out * buy) / entry)
    return df.withColumns({"gross": gross, "net": net})


#: Bars of a step, and steps of the longest horizon.
STEP = 16


def long_path_outcomes(signals: DataFrame, panel: DataFrame, longest: int) -> DataFrame:
    """:func:`path_outcomes` for horizons of up to ``longest`` bars, without a path in each row.

    ``signals`` hold (symbol, bar, close, side, stop, target, h). The lowest low and highest high of the next 16 bars are looked at in steps of 16
    bars until a barrier is touched; the 16 bars of that step are then looked at one by one. Each look is an equi-join by symbol and number of bar, so a symbol of a
    third of all rows is spread over its bars.
    """
    ahead = ws().rowsBetween(1, STEP)
    bars = panel.select("symbol", "bar", "high", "low", "close", (F.row_number().over(ws()) - 1).alias("rn"), F.min("low").over(ahead).alias("_low"), F.max("high").over(ahead).alias("_high"))
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lead("_low", STEP * k).over(ws()).alias("low"), F.lead("_high", STEP * k).over(ws()).alias("high")) for k in range(-(-longest // STEP))])
    coarse = bars.select("symbol", "bar", "rn", steps.alias("_steps"))
    each = F.array(*[F.struct(F.lit(j).alias("j"), *[F.lead(c, j).over(ws()).alias(c) for c in ("bar", "low", "high")]) for j in range(1, STEP + 1)])
    fine = bars.select("symbol", F.col("rn").alias("_at"), each.alias("_each"))

    long = F.col("side") == "LONG"
    under, over = F.when(long, F.col("stop")).otherwise(F.col("target")), F.when(long, F.col("target")).otherwise(F.col("stop"))
    df = signals.join(coarse, ["symbol", "bar"]).withColumns({"_under": under, "_over": over})
    touched = lambda x: (x["low"] <= F.col("_under")) | (x["high"] >= F.col("_over"))
    met = F.get(F.filter("_steps", lambda x: touched(x) & (x["k"] * STEP < F.col("h"))), F.lit(0))
    df = df.withColumn("_k", met["k"]).drop("_steps").withColumns({"_at": F.col("rn") + STEP * F.coalesce("_k", F.lit(0)), "_end": F.col("rn") + F.col("h")})
    df = df.join(bars.select("symbol", F.col("rn").alias("_end"), F.col("bar").alias("_end_bar"), F.col("close").alias("_close")), ["symbol", "_end"])
    df = df.join(fine, ["symbol", "_at"])
    one = F.get(F.filter("_each", lambda x: touched(x) & (F.col("_k") * STEP + x["j"] <= F.col("h"))), F.lit(0))
    df = df.withColumn("_one", one).drop("_each")
    stopped = F.when(long, F.col("_one.low") <= F.col("stop")).otherwise(F.col("_one.high") >= F.col("stop"))
    reason = F.when(F.col("_one").isNull(), "HORIZON_EXPIRY").when(stopped, "STOP_LOSS").otherwise("TARGET_PROFIT")
    df = df.withColumns({"exit_reason": reason, "exit_bar": F.coalesce("_one.bar", "_end_bar")})
    return settled(df).drop("rn", "_under", "_over", "_k", "_at", "_end", "_end_bar", "_close", "_one")


def calibration_bins(scored: DataFrame, keys: list[str], bins: int = 8) -> DataFrame:
    """Count, mean probability and observed share in each of equal bins."""
    bin_of = F.least(F.lit(bins - 1), F.floor(F.col("prob") * bins)).cast("int")
    return scored.groupBy(*keys, bin_of.alias("bin")).agg(F.count("*").alias("n"), F.avg("prob").alias("mean_prob"), F.avg("outcome").alias("observed"))


def calibration_metrics(scored: DataFrame, keys: list[str], bins: int = 8) -> DataFrame:
    """Brier score, expected and greatest calibration error and a quality mark, by key: two levels of aggregation, one row per bin between."""
    p, y = F.col("prob"), F.col("outcome")
    bin_of = F.least(F.lit(bins - 1), F.floor(p * bins)).cast("int")
    level = scored.groupBy(*keys, bin_of.alias("bin")).agg(F.count("*").alias("n"), F.sum("prob").alias("sp"), F.sum("outcome").alias("sy"), F.sum(F.pow(p - y, 2)).alias("se"))
    gap = F.abs(F.col("sp") - F.col("sy"))
    out = level.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        (F.sum("se") / F.sum("n")).alias("brier"),
        (F.sum(gap) / F.sum("n")).alias("ece"),
        F.max(gap / F.col("n")).alias("mce"),
        F.count("*").alias("populated_bins"),
    )
    mark = F.when((F.col("ece") <= 0.06) & (F.col("n") >= 50), "HIGH").when((F.col("ece") <= 0.12) & (F.col("n") >= 20), "MEDIUM").otherwise("POOR")
    return out.withColumn("quality", mark)


def auc(scored: DataFrame, keys: list[str]) -> DataFrame:
    """ROC area by rank sums and accuracy at one half; ties share their mean rank. Rows are first counted by probability."""
    level = scored.groupBy(*keys, "prob").agg(F.sum("outcome").cast("long").alias("pos"), F.count("*").alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("prob").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = level.withColumn("_rank", below + (F.col("n") + 1) / 2)
    right = F.when(F.col("prob") >= 0.5, F.col("pos")).otherwise(F.col("n") - F.col("pos"))
    sums = level.groupBy(*keys).agg(F.sum(F.col("_rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"), F.sum(right).alias("right"))
    area = F.coalesce((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * (F.col("n") - F.col("p")), F.lit(0)), F.lit(0.5))
    return sums.select(*keys, "n", area.alias("auc"), (F.col("right") / F.col("n")).alias("accuracy"))


def sets_of(df: DataFrame, keys: list[str], subtotals: list[list[str]], name: str = "ALL") -> tuple[GroupedData, list[Column]]:
    """``df`` grouped by ``keys`` and by each of the fewer keys of ``subtotals``, in one aggregation; and the keys, called ``name`` where a row is summed over them.

    A key that is null in the data stays null.
    """
    grouped = df.groupingSets([[F.col(k) for k in some] for some in [keys, *subtotals]], *[F.col(k) for k in keys])
    return grouped, [F.when(F.col(f"_over_{k}") == 1, F.lit(name)).otherwise(F.col(k)).alias(k) for k in keys]


def trade_metrics(trades: DataFrame, keys: list[str], subtotals: list[list[str]] | None = None) -> DataFrame:
    """Rates, gains, losses and profit factor of trades (gross, net, exit_reason) by any key, and by fewer of them as ``subtotals`` asks for."""
    net = F.col("net")
    gains, losses = F.sum(F.when(net > 0, net)), F.sum(F.when(net <= 0, net))
    grouped, named = sets_of(trades, keys, subtotals) if subtotals else (trades.groupBy(*keys), None)
    sums = grouped.agg(
        *[F.grouping(k).alias(f"_over_{k}") for k in keys if subtotals],
        F.count("*").alias("trades"),
        (F.avg((F.col("gross") > 0).cast("double")) * 100).alias("win_rate"),
        (F.avg(F.when(net > 0, net)) * 100).alias("avg_gain"),
        (F.avg(F.when(net <= 0, net)) * 100).alias("avg_loss"),
        (F.avg(net) * 100).alias("avg_return"),
        (F.avg((F.col("exit_reason") == "TARGET_PROFIT").cast("double")) * 100).alias("target_hit_rate"),
        F.coalesce(F.coalesce(gains, F.lit(0.0)) / F.nullif(F.abs(losses), F.lit(0.0)), F.when(gains > 0, 99.0).otherwise(0.0)).alias("profit_factor"),
    )
    return sums.select(*named, *[c for c in sums.columns if c not in keys and not c.startswith("_over_")]) if named else sums


def equity_curve(trades: DataFrame, keys: list[str], order: list[str], share: float = 1.0) -> DataFrame:
    """Compound equity from 100 along the trades' exits, and the fall from its peak. A loss of everything leaves 0.

    Log returns run within a day (``order``'s first column) and are carried from day to day over one row per day, so the trades of one key
    are spread over its days.
    """
    day, rest = order[0], order[1:] or order[:1]
    gain = F.log(F.greatest(F.lit(1e-9), 1 + share * F.col("net")))
    within = Window.partitionBy(*keys, day).orderBy(*rest).rowsBetween(Window.unboundedPreceding, 0)
    df = trades.withColumn("_sum", F.sum(gain).over(within)).withColumn("_top", F.max("_sum").over(within))
    days = df.groupBy(*keys, day).agg(F.sum(gain).alias("_all"), F.max("_sum").alias("_high"))
    along = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_before", F.coalesce(F.sum("_all").over(along), F.lit(0.0))).withColumn("_peak", F.max(F.col("_before") + F.col("_high")).over(along))
    df = df.join(days.select(*keys, day, "_before", "_peak"), [*keys, day])
    level = F.col("_before") + F.col("_sum")
    peak = F.greatest(F.lit(0.0), F.col("_peak"), F.col("_before") + F.col("_top"))
    return df.withColumns({"equity": 100 * F.exp(level), "drawdown": F.exp(level - peak) - 1}).drop("_sum", "_top", "_before", "_peak")


def risk_metrics(trades: DataFrame, keys: list[str], order: list[str], days: Column, share: float = 0.05, free: float = 0.065) -> DataFrame:
    """Growth, Sharpe, Sortino, drawdown and Calmar by key; ``days`` are the trading days that n trades span."""
    r = share * F.col("net")
    curve = equity_curve(trades, keys, order, share)
    sums = curve.groupBy(*keys).agg(
        F.count("*").alias("n"),
        (100 * F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 + r))))).alias("final"),
        F.avg(r).alias("mean"),
        F.stddev_pop(r).alias("std"),
        F.sqrt(F.sum(F.when(r < 0, r * r)) / F.count("*")).alias("down"),
        F.least(F.lit(0.0), F.min("drawdown")).alias("max_drawdown"),
    )
    cagr = F.pow(F.greatest(F.lit(0.01), F.col("final") / 100), 252 / days) - 1
    df = sums.withColumn("cagr", cagr)
    return df.select(
        *keys,
        "n",
        "final",
        "cagr",
        "max_drawdown",
        ratio(F.col("mean") * 252 - free, F.col("std") * F.sqrt(F.lit(252.0))).alias("sharpe"),
        ratio(F.col("mean") * 252 - free, F.col("down") * F.sqrt(F.lit(252.0))).alias("sortino"),
        F.abs(ratio(F.col("cagr"), F.col("max_drawdown"))).alias("calmar"),
    )


def fit_buckets(scored: DataFrame) -> DataFrame:
    """Conditional gains and losses by horizon: for all, for three broad ranges (closed at both ends) and for seven fine ones.

    Means leave out the lowest and highest tenth. A row stands in up to four buckets; those with too few rows are dropped.
    """
    broad = [("BROAD", 0.0, 0.45, 5), ("BROAD", 0.45, 0.55, 5), ("BROAD", 0.55, 1.0, 5)]
    fine = [("FINE", round(0.2 + 0.1 * k, 2), round(0.3 + 0.1 * k, 2), 15) for k in range(7)]
    edges = [("HORIZON_WIDE", 0.0, 1.0, 5), *broad, *fine]
    held = F.filter(
        F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(lo).alias("low"), F.lit(hi).alias("high"), F.lit(n).alias("least")) for k, lo, hi, n in edges]),
        lambda b: (b["kind"] == "HORIZON_WIDE") | ((F.col("prob") >= b["low"]) & ((F.col("prob") < b["high"]) | ((b["kind"] == "BROAD") & (F.col("prob") <= b["high"])))),
    )
    rows = scored.select("horizon", "ret", F.explode(held).alias("b")).select("horizon", "b.*", "ret", (F.col("ret") > 0).alias("up"))
    side = ["horizon", "kind", "low", "high", "least", "up"]
    # places are counted within cells of a thousandth and moved on by the cells before, so a side is spread over its cells
    rows = rows.withColumn("_cell", F.floor(F.abs("ret") * 1000))
    cells = rows.groupBy(*side, "_cell").agg(F.count("*").alias("_n"))
    every = Window.partitionBy(*side)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_n").over(every.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cells = cells.withColumn("_size", F.sum("_n").over(every)).drop("_n")
    rows = rows.join(cells, [*side, "_cell"])
    size, place = F.col("_size"), F.col("_before") + F.row_number().over(Window.partitionBy(*side, "_cell").orderBy(F.abs("ret")))
    cut = F.floor(size * 0.1)
    kept = rows.withColumn("_kept", (place > cut) & (place <= size - cut))
    out = kept.groupBy("horizon", "kind", "low", "high", "least").agg(
        F.coalesce(F.round(F.avg(F.when(F.col("_kept") & F.col("up"), F.col("ret"))), 4), F.lit(0.02)).alias("gain"),
        F.coalesce(F.round(F.avg(F.when(F.col("_kept") & ~F.col("up"), F.abs("ret"))), 4), F.lit(0.015)).alias("loss"),
        F.round(F.stddev_samp("ret"), 4).alias("dispersion"),
        F.round(F.stddev_samp("ret") / F.sqrt(F.count("*")), 4).alias("uncertainty"),
        F.count("*").alias("n"),
    )
    return out.where(F.col("n") >= F.col("least")).drop("least")


def fit_binned_isotonic(scored: DataFrame, bins: int = 8, least: int = 15, prior: int = 10) -> DataFrame:
    """Knots (horizon, x, y) of a non-decreasing fit on equal-count bins, sparse ones pulled towards one half, with anchors at 0.05 and 0.95.

    Pooling adjacent violators is written as max over j <= i of min over k >= i of the mean of bins j to k: at most ``bins`` rows per horizon.
    """
    # rows are counted by probability and outcome first; those of one count may fall into several bins
    counts = scored.groupBy("horizon", "prob", "outcome").agg(F.count("*").alias("k"))
    own = Window.partitionBy("horizon")
    counts = counts.withColumn("upto", F.sum("k").over(own.orderBy("prob", "outcome").rowsBetween(Window.unboundedPreceding, 0)))
    counts = counts.withColumns({"begin": F.col("upto") - F.col("k"), "size": F.greatest(F.lit(1), F.floor(F.sum("k").over(own) / bins))})
    first, last = (F.least(F.lit(bins - 1), F.floor(x / F.col("size"))).cast("int") for x in (F.col("begin"), F.col("upto") - 1))
    spread = counts.withColumn("bin", F.explode(F.sequence(first, last)))
    end = F.when(F.col("bin") == bins - 1, F.col("upto")).otherwise(F.least(F.col("upto"), (F.col("bin") + 1) * F.col("size")))
    spread = spread.withColumn("k", end - F.greatest(F.col("begin"), F.col("bin") * F.col("size")))
    level = spread.groupBy("horizon", "bin").agg(F.sum(F.col("prob") * F.col("k")).alias("sp"), F.sum(F.col("outcome") * F.col("k")).alias("sy"), F.sum("k").alias("n"))
    packed = level.groupBy("horizon").agg(F.sort_array(F.collect_list(F.struct("bin", "sp", "sy", "n"))).alias("b"))

    def mean(j: Column, k: Column) -> Column:
        part = F.slice("b", j + 1, k - j + 1)
        return F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x["sy"]) / F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x["n"])

    def fit(x: Column, i: Column) -> Column:
        low = F.transform(F.sequence(F.lit(0), i), lambda j: F.array_min(F.transform(F.sequence(i, F.size("b") - 1), lambda k: mean(j, k))))
        return F.struct(x["sp"].alias("sp"), x["n"].alias("n"), F.round(F.array_max(low), 10).alias("y"))

    fitted = packed.select("horizon", F.explode(F.transform("b", fit)).alias("f")).select("horizon", "f.*")
    blocks = fitted.groupBy("horizon", "y").agg((F.sum("sp") / F.sum("n")).alias("x"), F.sum("n").alias("n"))
    pulled = F.when(F.col("n") < least, (F.col("y") * F.col("n") + 0.5 * prior) / (F.col("n") + prior)).otherwise(F.col("y"))
    knots = blocks.select("horizon", F.round(F.greatest(F.lit(0.05), F.least(F.lit(0.95), F.col("x"))), 3).alias("x"), F.round(F.greatest(F.lit(0.08), F.least(F.lit(0.92), pulled)), 3).alias("y"), "n")
    ends = knots.groupBy("horizon").agg(F.min(F.struct("x", "y")).alias("a"), F.max(F.struct("x", "y")).alias("z"))
    low = F.round(F.greatest(F.lit(0.05), F.col("a.y") - (F.col("a.x") - 0.05) * 0.8), 3)
    high = F.round(F.least(F.lit(0.95), F.col("z.y") + (0.95 - F.col("z.x")) * 0.8), 3)
    below = ends.where("a.x > 0.05").select("horizon", F.lit(0.05).alias("x"), low.alias("y"), F.lit(0).cast("long").alias("n"))
    above = ends.where("z.x < 0.95").select("horizon", F.lit(0.95).alias("x"), high.alias("y"), F.lit(0).cast("long").alias("n"))
    up = Window.partitionBy("horizon").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    return knots.unionByName(below).unionByName(above).withColumn("y", F.max("y").over(up))
