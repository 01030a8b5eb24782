"""Portfolios from a ledger: holdings, values, concentration, brackets and exit signals."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import money, money_times, return_percent

HOLDINGS = "portfolio long, symbol string, qty long, average double, cash double, accepted long, rejected long"


def execute(orders: Iterable[tuple], cash: float, held: dict[str, tuple[int, float]]) -> tuple[float, dict[str, tuple[int, float]], list[int]]:
    """Cash, holdings (quantity and average price by symbol) and counts of accepted and rejected orders after these (symbol, side, qty, price)."""
    held, counts = dict(held), [0, 0]
    for symbol, side, amount, price in orders:
        qty, average = held.get(symbol, (0, 0.0))
        value = round(amount * price, 2)
        if amount <= 0 or (side == "BUY" and value > cash) or (side == "SELL" and amount > qty):
            counts[1] += 1
            continue
        counts[0] += 1
        if side == "BUY":
            held[symbol] = (qty + amount, round((qty * average + value) / (qty + amount), 2))
            cash = round(cash - value, 2)
        else:
            held[symbol] = (qty - amount, average)
            cash = round(cash + value, 2)
            if qty == amount:
                del held[symbol]
    return cash, held, counts


def replay(ledger: DataFrame, cash: float = 1_000_000.0) -> DataFrame:
    """Holdings and cash by replaying each portfolio's orders in turn: buys over the cash and sells over the holding are rejected.

    Rejection depends on all orders before, so each portfolio is one ordered fold. Tasks get sorted orders and read them as a stream: what is held is one
    Arrow batch and one portfolio's holdings, however many orders it has.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, left, held, counts = None, cash, {}, [0, 0]

        def told() -> list[tuple]:
            if now is None:
                return []
            return [(now, s, q, a, left, *counts) for s, (q, a) in sorted(held.items())] or [(now, None, 0, 0.0, left, *counts)]

        names = [x.split()[0] for x in HOLDINGS.split(", ")]
        for batch in batches:
            out = []
            for portfolio, orders in batch.groupby("portfolio", sort=False):
                if portfolio != now:
                    out += told()
                    now, left, held, counts = portfolio, cash, {}, [0, 0]
                left, held, more = execute(orders[["symbol", "side", "qty", "price"]].itertuples(index=False, name=None), left, held)
                counts = [counts[0] + more[0], counts[1] + more[1]]
            if out:
                yield pd.DataFrame(out, columns=names)
        if now is not None:
            yield pd.DataFrame(told(), columns=names)

    orders = ledger.select("portfolio", "symbol", "ts", "side", F.col("qty").cast("long").alias("qty"), F.col("price").cast("double").alias("price"), F.to_json("seq").alias("seq_key"))
    dealt = orders.where("portfolio IS NOT NULL").repartition("portfolio").sortWithinPartitions("portfolio", "ts", "seq_key")
    return dealt.select("portfolio", "symbol", "side", "qty", "price").mapInPandas(fold, HOLDINGS)


def summary(valued: DataFrame, cash: float = 1_000_000.0) -> DataFrame:
    """Totals per portfolio of valued positions."""
    sums = valued.groupBy("portfolio").agg(*[F.sum(c).cast("decimal(18,2)").alias(c) for c in ("invested", "current_value", "today_pnl")], F.count("*").alias("positions"))
    total = (F.col("current_value") + money(F.lit(cash))).cast("decimal(18,2)")
    return sums.withColumns(
        {"total_value": total, "pnl": (F.col("current_value") - F.col("invested")).cast("decimal(18,2)"), "pnl_percent": return_percent(F.col("current_value"), F.col("invested"))}
    )


def concentration(valued: DataFrame, universe: DataFrame, cash: float = 1_000_000.0, position_limit: float = 20, sector_limit: float = 40) -> DataFrame:
    """Each position's and its sector's share of the portfolio, with alerts. Positions of a portfolio are few."""
    df = valued.join(universe.select("symbol", "sector"), "symbol", "left").withColumn("sector", F.coalesce("sector", F.lit("General")))
    value = F.col("current_value").cast("double")
    total = F.sum(value).over(Window.partitionBy("portfolio")) + cash
    weight = value / total * 100
    sector = F.sum(value).over(Window.partitionBy("portfolio", "sector")) / total * 100
    return df.select(
        "portfolio",
        "symbol",
        "sector",
        weight.alias("weight"),
        sector.alias("sector_weight"),
        (weight * 0.2).alias("marginal_risk"),
        (weight >= position_limit).cast("int").alias("position_alert"),
        (sector >= sector_limit).cast("int").alias("sector_alert"),
    )


def drill_down(valued: DataFrame, universe: DataFrame, cash: float = 1_000_000.0, limit: float = 40) -> DataFrame:
    """Totals of positions by portfolio and sector, by portfolio, by sector and of all, from one aggregation. ``level`` tells which keys a row is of.

    ``weight`` is a sector's share of its portfolio with its cash, in percent; null above the portfolios. Sectors without a name are ``General``.
    """
    df = valued.join(universe.select("symbol", "sector"), "symbol", "left").withColumn("sector", F.coalesce("sector", F.lit("General")))
    sums = df.cube("portfolio", "sector").agg(
        F.grouping_id().alias("_id"), F.count("*").alias("positions"), *[F.sum(c).cast("decimal(18,2)").alias(c) for c in ("invested", "current_value", "today_pnl")]
    )
    level = F.element_at(F.array(F.lit("SECTOR_OF_PORTFOLIO"), F.lit("PORTFOLIO"), F.lit("SECTOR"), F.lit("ALL")), (F.col("_id") + 1).cast("int"))
    # a portfolio has a row for each sector and one of its own
    whole = F.max(F.when(F.col("_id") == 1, F.col("current_value").cast("double"))).over(Window.partitionBy("portfolio", F.col("_id") > 1)) + cash
    weight = F.when(F.col("_id") <= 1, F.col("current_value").cast("double") / whole * 100)
    told = sums.withColumns({"level": level, "weight": weight, "pnl": (F.col("current_value") - F.col("invested")).cast("decimal(18,2)")})
    alert = ((F.col("_id") == 0) & (F.col("weight") >= limit)).cast("int")
    return told.select("level", "portfolio", "sector", "positions", "invested", "current_value", "today_pnl", "pnl", "weight", alert.alias("alert"))


def journal(trades: DataFrame, universe: DataFrame, text: str = "", side: str | None = None, order: str = "newest") -> DataFrame:
    """Trades whose symbol or name holds ``text``, of one side or both, in order: ``newest``, ``oldest`` or ``highest_value``."""
    value = money_times(F.col("qty"), F.col("price"))
    named = trades.join(universe.select("symbol", "name"), "symbol", "left").withColumn("value", value)
    found = F.lower("symbol").contains(text.lower()) | F.coalesce(F.lower("name").contains(text.lower()), F.lit(False))
    kept = named.where(found & (F.col("side") == side if side else F.lit(True)))
    return kept.orderBy({"newest": F.desc("ts"), "oldest": F.asc("ts"), "highest_value": F.desc("value")}[order])


def user_alerts(alerts: DataFrame) -> DataFrame:
    """Active alerts (user, symbol, level, condition, created, active), each user's newest first, with the condition's shown name."""
    shown = F.when(F.col("condition") == "GREATER_THAN", "ABOVE").otherwise("BELOW")
    place = F.row_number().over(Window.partitionBy("user").orderBy(F.desc("created"), "symbol", "level"))
    return alerts.where("active").select("user", "symbol", "level", shown.alias("condition"), "created", place.cast("long").alias("place"))


def brackets(buys: DataFrame) -> DataFrame:
    """Stop and target of buys (price, model_stop, model_target): 5% under and 8% over, unless the model's lie on the right side."""
    price = F.col("price")
    return buys.withColumns(
        {
            "stop": F.when((F.col("model_stop") > 0) & (F.col("model_stop") < price), F.col("model_stop")).otherwise(price * 0.95),
            "target": F.when(F.col("model_target") > price, F.col("model_target")).otherwise(price * 1.08),
        }
    )


def exit_signals(positions: DataFrame, rated: DataFrame) -> DataFrame:
    """Positions (portfolio, symbol, current_price, target_price) that the latest ratings (one per symbol) say to leave."""
    df = positions.join(rated.select("symbol", "decision", "downside", "stop_loss", "target", "risk_score", "risk_state"), "symbol")
    price, score = F.col("current_price"), F.col("risk_score")
    stop, target = price <= F.col("stop_loss"), F.coalesce(price >= F.col("target_price"), F.lit(False))
    emergency, deep = F.col("risk_state") == "EMERGENCY", F.col("downside") > 0.60
    leave = F.col("decision").isin("SELL", "STRONG_SELL", "REDUCE") | deep | stop | target | (score >= 65) | emergency
    action = (
        F.when(target, "TAKE_PROFIT")
        .when(stop | emergency | (F.col("decision") == "STRONG_SELL") | (score >= 85), "STRONG_SELL")
        .when(F.col("decision") == "REDUCE", "REDUCE")
        .otherwise("SELL")
    )
    urgency = F.when(stop | emergency | (score >= 85), "HIGH").when((score >= 65) | deep, "MEDIUM").otherwise("LOW")
    return df.where(leave).select("portfolio", "symbol", action.alias("action"), urgency.alias("urgency"), F.when(stop | target, price).otherwise(F.col("target")).alias("exit_price"))
