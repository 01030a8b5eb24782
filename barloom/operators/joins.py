"""Joins of panels, quotes, knots, buckets and headlines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import clamp, money, money_times, return_percent
from barloom.operators.features import ws


def value_positions(positions: DataFrame, quotes: DataFrame) -> DataFrame:
    """Positions (portfolio, symbol, qty, average) with the quote's price, the average where there is none."""
    joined = positions.join(quotes.select("symbol", F.col("price").alias("quote"), "prev_close"), "symbol", "left")
    current = F.coalesce(F.nullif("quote", F.lit(0.0)), F.col("average").cast("double"))
    before = F.coalesce(F.nullif("prev_close", F.lit(0.0)), current)
    df = joined.withColumns({"current_price": current, "_before": before})
    df = df.withColumns(
        {
            "invested": money_times(F.col("qty"), F.col("average")),
            "current_value": money_times(F.col("qty"), F.col("current_price")),
            "today_pnl": money_times(F.col("qty"), F.col("current_price") - F.col("_before")),
        }
    )
    df = df.withColumn("pnl", money(F.col("current_value") - F.col("invested")))
    return df.withColumn("pnl_percent", return_percent(F.col("current_value"), F.col("invested"))).drop("quote", "prev_close", "_before")


def enrich_trades(trades: DataFrame, universe: DataFrame, quotes: DataFrame) -> DataFrame:
    """Trades with their symbol's sector and what the price did since. Both dimensions hold one row per symbol."""
    df = trades.join(universe.select("symbol", "name", "sector"), "symbol", "left").join(quotes.select("symbol", F.col("price").alias("quote")), "symbol", "left")
    current = money(F.coalesce("quote", F.col("price").cast("double")))
    return df.select(
        *trades.columns,
        F.coalesce("sector", F.lit("Equities")).alias("sector"),
        current.alias("current_price"),
        (current - F.col("price")).cast("decimal(18,2)").alias("delta"),
        return_percent(current, F.col("price")).alias("delta_percent"),
        money_times(F.col("qty"), F.col("price")).alias("total_value"),
    )


#: Postings of names that are broadcast at once.
NAMES = 100_000


def grams(text: Column) -> Column:
    """The different runs of three characters of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), F.lit(1)))


def postings(names: DataFrame, key: str, words: list[tuple[Column, int]]) -> DataFrame:
    """(gram, key, _kind, _word, _earlier): each name's words (with the characters they need, three at least) under the gram that fewest words hold.

    ``_kind`` is a word's place in the list, ``_earlier`` are the name's words before it. Names are one row each.
    """
    held = F.array(*[F.when(F.length(w) >= n, w) for w, n in words])
    each = names.select(key, held.alias("_held")).select(key, "_held", F.posexplode("_held").alias("_kind", "_word")).where("_word IS NOT NULL")
    earlier = F.filter(F.slice("_held", F.lit(1), F.col("_kind")), lambda w: w.isNotNull())
    cut = each.select(key, "_kind", "_word", earlier.alias("_earlier"), F.explode(grams(F.col("_word"))).alias("gram"))
    lists = cut.groupBy("gram").agg(F.count_distinct("_word").alias("_n"))
    rarest = cut.join(lists, "gram").groupBy(key, "_kind").agg(F.min_by(F.struct("gram", "_word", "_earlier"), F.struct("_n", "gram")).alias("p"))
    return rarest.select("p.gram", key, "_kind", "p._word", "p._earlier")


def containing(texts: DataFrame, names: DataFrame, key: str, words: list[tuple[Column, int]], text: str = "title") -> DataFrame:
    """``texts`` joined with the ``key`` of the names one of whose ``words`` stands in the text, in lower case; ``_kind`` is the first one that does.

    A text's grams are joined with the words' rarest ones, and the few words found so are looked for in the text, all in one stage: texts aren't
    shuffled. A pair comes once, as each word stands under one gram and gives way to the name's words before it. The
    postings are broadcast; more than ``NAMES`` of them in parts by gram, each of which meets its own grams only. Texts without three characters hold no word.
    """
    index = postings(names, key, words)
    parts = -(-index.count() // NAMES) or 1
    lowered = texts.withColumn("_text", F.lower(text))
    mine = grams(F.col("_text"))
    out = []
    for k in range(parts):
        some = index if parts == 1 else index.where(F.pmod(F.xxhash64("gram"), F.lit(parts)) == k)
        own = mine if parts == 1 else F.filter(mine, lambda g: F.pmod(F.xxhash64(g), F.lit(parts)) == k)  # noqa: B023
        met = lowered.select("*", F.explode(own).alias("gram")).join(F.broadcast(some), "gram")
        first = ~F.exists("_earlier", lambda w: F.contains(F.col("_text"), w))
        out.append(met.where(F.contains(F.col("_text"), F.col("_word")) & first).select(*texts.columns, key, "_kind"))
    return reduce(DataFrame.unionByName, out)


def tag_headlines(headlines: DataFrame, universe: DataFrame) -> DataFrame:
    """The first symbol, by rank, whose ticker (from three letters) or name's first word (from four) stands in the title.

    Ranks are unique. The join is :func:`containing`.
    """
    words = [(F.lower("symbol"), 3), (F.lower(F.split("name", " ")[0]), 4)]
    firsts = containing(headlines.select("id", "title"), universe, "rank", words).groupBy("id").agg(F.min("rank").alias("rank"))
    tagged = firsts.join(universe.select("rank", F.col("symbol").alias("affected")), "rank").select("id", "affected")
    return headlines.join(tagged, "id", "left")


def interpolate(p: Column, knots: list[tuple[float, float]]) -> Column:
    """Probabilities through piecewise-linear knots, clamped outside; as they are with fewer than two knots. Knots are a short list."""
    p = clamp(p, 0.01, 0.99)
    if len(knots) < 2:
        return F.round(p, 4)
    out = F.when(p <= knots[0][0], F.lit(float(knots[0][1]))).when(p >= knots[-1][0], F.lit(float(knots[-1][1])))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:], strict=False):
        inside = F.lit(float(y0)) if x1 == x0 else clamp(y0 + (p - x0) / (x1 - x0) * (y1 - y0), 0.05, 0.95)
        out = out.when(p <= x1, F.round(inside, 4))
    return out


def calibrate(scored: DataFrame, knots: DataFrame, prob: str = "prob") -> DataFrame:
    """``scored`` with ``calibrated`` from a table of knots (horizon, x, y): each horizon's few knots travel as one array."""
    packed = knots.groupBy("horizon").agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("_k"))
    df = scored.join(F.broadcast(packed), "horizon", "left").withColumn("_p", clamp(F.col(prob), 0.01, 0.99))
    n = F.size("_k")
    first, last = F.get("_k", F.lit(0)), F.get("_k", n - 1)
    low = F.array_max(F.filter("_k", lambda k: k["x"] <= F.col("_p")))
    high = F.array_min(F.filter("_k", lambda k: k["x"] > F.col("_p")))
    between = low["y"] + (F.col("_p") - low["x"]) / (high["x"] - low["x"]) * (high["y"] - low["y"])
    value = (
        F.when(F.col("_k").isNull() | (n < 2), F.round("_p", 4))
        .when(F.col("_p") <= first["x"], first["y"])
        .when(F.col("_p") >= last["x"], last["y"])
        .otherwise(F.round(clamp(between, 0.05, 0.95).cast("decimal(24,10)"), 4).cast("double"))
    )
    return df.withColumn("calibrated", value).drop("_k", "_p")


def lookup_buckets(scored: DataFrame, buckets: DataFrame, prob: str = "prob") -> DataFrame:
    """The narrowest bucket that holds the probability: fine, else broad (the first of two that touch), else the horizon's.

    Buckets (horizon, kind, low, high, gain, loss, ...) are some dozen rows, carried as one array per horizon.
    """
    rank = F.when(F.col("kind") == "FINE", 0).when(F.col("kind") == "BROAD", 1).otherwise(2)
    packed = buckets.groupBy("horizon").agg(
        F.sort_array(F.collect_list(F.struct(rank.alias("rank"), "low", "high", "kind", "gain", "loss", "dispersion", "uncertainty", "n"))).alias("_b")
    )
    df = scored.join(F.broadcast(packed), "horizon", "left")
    p = F.col(prob)
    held = F.filter("_b", lambda b: (p >= b["low"]) & ((p < b["high"]) | ((b["rank"] > 0) & (p <= b["high"]))))
    return df.withColumn("bucket", F.get(held, F.lit(0))).drop("_b")


def forward_path(panel: DataFrame, h: int) -> DataFrame:
    """Each bar with the next h bars of its symbol, in order, as an array: one shuffle."""
    bar = F.struct("bar", "high", "low", "close")
    return panel.withColumn("path", F.collect_list(bar).over(ws().rowsBetween(1, h)))


def without_recent_exit(signals: DataFrame, sells: DataFrame, seconds: int = 60) -> DataFrame:
    """Exit signals (portfolio, symbol, ts) of positions that weren't sold in the ``seconds`` before."""
    s, x = signals.alias("s"), sells.alias("x")
    recent = (
        (F.col("s.portfolio") == F.col("x.portfolio"))
        & (F.col("s.symbol") == F.col("x.symbol"))
        & (F.col("x.ts") < F.col("s.ts"))
        & (F.col("x.ts") >= F.col("s.ts") - F.make_dt_interval(secs=F.lit(seconds)))
    )
    return s.join(x, recent, "left_anti")


def watch(items: DataFrame, universe: DataFrame, quotes: DataFrame) -> DataFrame:
    """Watch-list entries (owner, symbol, added) with name and price."""
    return items.join(universe.select("symbol", "name"), "symbol").join(quotes.select("symbol", "price"), "symbol").orderBy(F.desc("added"), "symbol")


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by ``order``, an aggregation without a sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def top(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key; Spark limits each task's rows before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", place).where(F.col("rank") <= n)
