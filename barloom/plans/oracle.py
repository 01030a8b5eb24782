"""SQL building blocks for the checks: named table expressions and how they depend on each other."""

from __future__ import annotations

import re

SEQ = "row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"

WINDOWS = ", ".join(f"w{n} AS (PARTITION BY symbol ORDER BY bar ROWS {n - 1} PRECEDING)" for n in (3, 14, 20, 50, 60, 100, 200, 252))
WINDOWS = f"WINDOW ws AS (PARTITION BY symbol ORDER BY bar), {WINDOWS}"

# Wilder's smoothing in closed form: the seed is the mean of values 1 to 14, at row 14
WILDER = """SELECT a.symbol, a.rn,
  sum(greatest(b.delta, 0) * CASE WHEN b.rn <= 14 THEN pow(13 / 14.0, a.rn - 14) / 14 ELSE pow(13 / 14.0, a.rn - b.rn) / 14 END) AS ag,
  sum(greatest(-b.delta, 0) * CASE WHEN b.rn <= 14 THEN pow(13 / 14.0, a.rn - 14) / 14 ELSE pow(13 / 14.0, a.rn - b.rn) / 14 END) AS al,
  sum(b.tr * CASE WHEN b.rn <= 14 THEN pow(13 / 14.0, a.rn - 14) / 14 ELSE pow(13 / 14.0, a.rn - b.rn) / 14 END) AS atr
  FROM moves a JOIN moves b ON a.symbol = b.symbol AND b.rn BETWEEN 1 AND a.rn WHERE a.rn >= 14 GROUP BY a.symbol, a.rn"""
DRAWDOWNS = """SELECT symbol, rn, max(CASE WHEN depth20 THEN dd20 END) AS max_drawdown_20d, max(dd60) AS max_drawdown_60d FROM (
  SELECT a.symbol, a.rn, b.rn > a.rn - 20 AS depth20,
    1 - b.close / max(b.close) OVER (PARTITION BY a.symbol, a.rn ORDER BY b.rn) AS dd60,
    1 - b.close / max(CASE WHEN b.rn > a.rn - 20 THEN b.close END) OVER (PARTITION BY a.symbol, a.rn ORDER BY b.rn) AS dd20
  FROM bars_n a JOIN bars_n b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn - 59 AND a.rn) GROUP BY symbol, rn"""
TAILS = """SELECT symbol, rn, CASE WHEN len(rs) >= 20 THEN list_sort(rs)[floor(len(rs) * 0.05)::INT + 1] ELSE -0.03 END AS tail,
  100.0 * len(list_filter(cs, lambda x: x < close)) / len(cs) AS pct FROM (
  SELECT symbol, rn, close, list_filter(list(r) OVER w60, lambda x: x IS NOT NULL) AS rs, list(close) OVER w60 AS cs FROM moves
  WINDOW w60 AS (PARTITION BY symbol ORDER BY bar ROWS 59 PRECEDING))"""
KS = f"SELECT symbol, rn, CASE WHEN rn >= 13 THEN 100 * (close - min(low) OVER w14) / nullif(max(high) OVER w14 - min(low) OVER w14, 0) END AS k FROM moves {WINDOWS}"
EXTRA = f"""SELECT symbol, bar, close,
  CASE WHEN rn >= 14 THEN CASE WHEN al = 0 THEN 100 ELSE 100 - 100 / (1 + ag / al) END END AS rsi_14_wilder,
  e12 - e26 AS macd_line, signal AS macd_signal, e12 - e26 - signal AS macd_hist_raw,
  CASE WHEN count(k) OVER w3 >= 3 THEN avg(k) OVER w3 END AS stoch_d,
  close / lag(close, 10) OVER ws - 1 AS momentum_10, atr AS atr_14,
  CASE WHEN count(r) OVER w20 >= 10 THEN stddev_pop(r) OVER w20 * sqrt(252) END AS ann_vol_pop,
  CASE WHEN count(r) OVER w20 >= 10 THEN sqrt(avg(pow(CASE WHEN r < 0 THEN r ELSE 0 END, 2)) FILTER (r IS NOT NULL) OVER w20) * sqrt(252) END AS downside_raw,
  max_drawdown_20d, max_drawdown_60d, coalesce(avg(abs(gap)) OVER w20, 0.005) AS gap_risk, tail AS tail_risk_5pct,
  stddev_pop(volume) OVER w20 / avg(volume) OVER w20 AS volume_stability,
  log10(greatest(1, close * avg(volume) OVER w20)) AS liquidity_score,
  CASE WHEN count(CASE WHEN r IS NOT NULL AND rb IS NOT NULL THEN 1 END) OVER w60 >= 20 THEN covar_pop(r, rb) OVER w60 / nullif(var_pop(rb) OVER w60, 0) END AS beta,
  CASE WHEN rn >= 4 THEN (close - avg(close) OVER w20) / nullif(stddev_pop(close) OVER w20, 0) END AS close_zscore, pct AS close_percentile,
  CASE WHEN rn >= 149 THEN CASE WHEN avg(close) OVER w50 >= avg(close) OVER w200 THEN 'GOLDEN' ELSE 'DEATH' END END AS golden_cross,
  CASE WHEN rn >= 19 THEN avg(close) OVER w20 END AS bb_middle, stddev_pop(close) OVER w20 AS sd20,
  CASE WHEN count(r) OVER w20 >= 10 THEN sqrt(avg(CASE WHEN r IS NULL THEN NULL WHEN r < 0 THEN r * r ELSE 0 END) OVER w20) * sqrt(252) END AS downside_pop
  FROM moves LEFT JOIN wilder USING (symbol, rn) JOIN emas USING (symbol, rn) JOIN signals USING (symbol, rn)
  JOIN drawdowns USING (symbol, rn) JOIN tails USING (symbol, rn) JOIN ks USING (symbol, rn) {WINDOWS}"""
EXTRA = EXTRA.replace("  CASE WHEN count(r) OVER w20 >= 10 THEN sqrt(avg(pow(CASE WHEN r < 0 THEN r ELSE 0 END, 2)) FILTER (r IS NOT NULL) OVER w20) * sqrt(252) END AS downside_raw,\n", "")

CTES = {
    "trades": f"""SELECT p_brand AS symbol, l_shipdate, l_extendedprice / l_quantity AS px, l_quantity AS qty, {SEQ} AS seq, l_returnflag
      FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "bars": """SELECT symbol, date_trunc('week', l_shipdate)::DATE AS bar, arg_min(px, seq) AS open, max(px) AS high, min(px) AS low,
      arg_max(px, seq) AS close, sum(qty) AS volume FROM trades GROUP BY ALL""",
    "bench": "SELECT bar, round(avg(close::DECIMAL(18,8))::DOUBLE, 6) AS bclose FROM bars GROUP BY bar",
    "vix": """SELECT bar, CASE WHEN count(r) OVER w20 >= 20 THEN 100 * stddev_samp(r) OVER w20 END AS value
      FROM (SELECT bar, bclose / lag(bclose) OVER (ORDER BY bar) - 1 AS r FROM bench) WINDOW w20 AS (ORDER BY bar ROWS 19 PRECEDING)""",
    "ticks": "SELECT event_type AS symbol, ts, value AS px, 1.0 AS qty, event_id AS seq FROM events WHERE value <> 0",
    "ledger": f"""SELECT o_custkey AS portfolio, p_brand AS symbol, l_shipdate AS ts, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side,
      l_quantity::INT AS qty, (l_extendedprice / l_quantity)::DECIMAL(18,4)::DECIMAL(14,2) AS price, {SEQ} AS seq
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "universe": """SELECT *, CASE WHEN rank <= 8 THEN 'LARGE' WHEN rank <= 16 THEN 'MID' ELSE 'SMALL' END AS tier FROM (
      SELECT row_number() OVER (ORDER BY p_brand) AS rank, p_brand AS symbol, min(p_name) AS name, min(string_split(p_type, ' ')[1]) AS sector
      FROM part GROUP BY p_brand)""",
    "headlines": """SELECT doc_id AS id, text AS title, source,
      'https://news.example/' || source || '/' || doc_id AS url FROM documents""",
    "quotes": """SELECT symbol, bar, open, high, low, close AS price, volume, prev_close FROM (
      SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY bar) AS prev_close FROM bars)
      QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar DESC) = 1""",
    "aligned": """SELECT b.*, row_number() OVER ws - 1 AS rn, last_value(x.bclose IGNORE NULLS) OVER ws AS bclose
      FROM bars b LEFT JOIN bench x ON b.bar = x.bar WINDOW ws AS (PARTITION BY symbol ORDER BY b.bar)""",
    "moves": """SELECT *, close - lag(close) OVER ws AS delta, close / lag(close) OVER ws - 1 AS r, bclose / lag(bclose) OVER ws - 1 AS rb,
      greatest(high - low, abs(high - lag(close) OVER ws), abs(low - lag(close) OVER ws)) AS tr, (open - lag(close) OVER ws) / lag(close) OVER ws AS gap
      FROM aligned WINDOW ws AS (PARTITION BY symbol ORDER BY bar)""",
    "emas": """SELECT a.symbol, a.rn,
      sum(greatest(b.delta, 0) * pow(13 / 14.0, a.rn - b.rn)) AS sg, sum(greatest(-b.delta, 0) * pow(13 / 14.0, a.rn - b.rn)) AS sl,
      sum(b.close * pow(11 / 13.0, a.rn - b.rn) * CASE WHEN b.rn = 0 THEN 1 ELSE 2 / 13.0 END) AS e12,
      sum(b.close * pow(25 / 27.0, a.rn - b.rn) * CASE WHEN b.rn = 0 THEN 1 ELSE 2 / 27.0 END) AS e26,
      sum(b.close * pow(19 / 21.0, a.rn - b.rn) * CASE WHEN b.rn = 0 THEN 1 ELSE 2 / 21.0 END) AS e20
      FROM moves a JOIN moves b ON a.symbol = b.symbol AND b.rn <= a.rn GROUP BY a.symbol, a.rn""",
    "signals": """SELECT a.symbol, a.rn, sum((b.e12 - b.e26) * pow(0.8, a.rn - b.rn) * CASE WHEN b.rn = 0 THEN 1 ELSE 0.2 END) AS signal
      FROM emas a JOIN emas b ON a.symbol = b.symbol AND b.rn <= a.rn GROUP BY a.symbol, a.rn""",
    "panel": """SELECT symbol, bar, open, high, low, close, volume, rn,
      coalesce(CASE WHEN rn >= 14 AND sl > 0 THEN 100 - 100 / (1 + sg / sl) END, 50) AS rsi_14,
      (e12 - e26 - signal) / close AS macd_hist,
      coalesce(CASE WHEN count(*) OVER w14 >= 14 THEN 100 * (close - min(low) OVER w14) / nullif(max(high) OVER w14 - min(low) OVER w14, 0) END, 50) AS stoch_k,
      coalesce(100 * (close / lag(close, 12) OVER ws - 1), 0) AS roc_12,
      coalesce(CASE WHEN rn >= 19 THEN close / avg(close) OVER w20 - 1 END, 0) AS sma_20_dist,
      coalesce(CASE WHEN rn >= 49 THEN close / avg(close) OVER w50 - 1 END, 0) AS sma_50_dist,
      close / e20 - 1 AS ema_20_dist,
      coalesce(CASE WHEN rn >= 13 THEN avg(tr) OVER w14 / close END, 0.02) AS atr_percent,
      coalesce(CASE WHEN rn >= 19 THEN 4 * stddev_samp(close) OVER w20 / avg(close) OVER w20 END, 0.05) AS bb_width,
      coalesce(CASE WHEN rn >= 20 THEN stddev_samp(r) OVER w20 * sqrt(252) END, 0.2) AS vol_20d,
      coalesce(CASE WHEN rn >= 60 THEN stddev_samp(r) OVER w60 * sqrt(252) END, 0.2) AS vol_60d,
      coalesce(CASE WHEN rn >= 20 THEN stddev_samp(r) OVER w20 * sqrt(252) END, 0.2) AS annualized_volatility,
      coalesce(CASE WHEN rn >= 20 THEN stddev_samp(CASE WHEN r < 0 THEN r WHEN r >= 0 THEN 0 END) OVER w20 * sqrt(252) END, 0.15) AS downside_deviation,
      coalesce(r, 0) AS ret_1d, coalesce(close / lag(close, 5) OVER ws - 1, 0) AS ret_5d, coalesce(close / lag(close, 20) OVER ws - 1, 0) AS ret_20d,
      coalesce(close / lag(close, 5) OVER ws - 1, 0) AS momentum_5, coalesce(close / lag(close, 20) OVER ws - 1, 0) AS momentum_20,
      coalesce(gap, 0) AS gap_pct,
      coalesce(CASE WHEN rn >= 39 THEN close / max(high) OVER w252 - 1 END, 0) AS dist_52w_high,
      coalesce(CASE WHEN rn >= 39 THEN close / min(low) OVER w252 - 1 END, 0) AS dist_52w_low,
      coalesce(CASE WHEN rn >= 19 AND stddev_samp(volume) OVER w20 > 0 THEN greatest(-3, least(3, (volume - avg(volume) OVER w20) / stddev_samp(volume) OVER w20)) END, 0) AS volume_z_score,
      coalesce(CASE WHEN rn >= 19 THEN greatest(0.1, least(10, volume / avg(volume) OVER w20)) END, 1) AS rel_volume,
      coalesce(CASE WHEN count(CASE WHEN r IS NOT NULL AND rb IS NOT NULL THEN 1 END) OVER w60 >= 60
        THEN greatest(0.2, least(3, covar_samp(r, rb) OVER w60 / nullif(var_samp(rb) OVER w60, 0))) END, 1) AS beta_nifty,
      coalesce(close / lag(close, 20) OVER ws - bclose / lag(bclose, 20) OVER ws, 0) AS relative_strength_nifty
      FROM moves JOIN emas USING (symbol, rn) JOIN signals USING (symbol, rn)
      WINDOW ws AS (PARTITION BY symbol ORDER BY bar), w14 AS (PARTITION BY symbol ORDER BY bar ROWS 13 PRECEDING),
        w20 AS (PARTITION BY symbol ORDER BY bar ROWS 19 PRECEDING), w50 AS (PARTITION BY symbol ORDER BY bar ROWS 49 PRECEDING),
        w60 AS (PARTITION BY symbol ORDER BY bar ROWS 59 PRECEDING), w252 AS (PARTITION BY symbol ORDER BY bar ROWS 251 PRECEDING)""",
}

CTES |= {
    "wilder": WILDER,
    "bars_n": "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar) - 1 AS rn FROM bars",
    "drawdowns": DRAWDOWNS,
    "tails": TAILS,
    "ks": KS,
    "extra": EXTRA,
    "state": """SELECT panel.*, atr_14, max_drawdown_60d, gap_risk, tail_risk_5pct, liquidity_score, CAST(NULL AS DOUBLE) AS news_sentiment
      FROM panel JOIN extra USING (symbol, bar)""",
}


def layered(base: str, layers: list[dict[str, str]]) -> str:
    """A select over ``base`` with one level of expressions after the other."""
    out = f"SELECT * FROM {base}"
    for layer in layers:
        out = f"SELECT *, {', '.join(f'{e} AS {c}' for c, e in layer.items())} FROM ({out})"
    return out


def sql(body: str, **local: str) -> str:
    """``body`` with the table expressions it uses, and those that they use, in front."""
    known = CTES | local
    used: dict[str, str] = {}

    def need(text: str) -> None:
        for name in known:
            if name not in used and re.search(rf"\b{name}\b", text):
                used[name] = ""  # marks it as being looked at
                need(known[name])
                del used[name]
                used[name] = known[name]

    need(body)
    own = {name for name, text in used.items() if re.search(rf"\b{name}\b", text)}  # these refer to themselves
    parts = [f"{name} AS {'' if name in own else 'MATERIALIZED '}({text})" for name, text in used.items()]
    return (f"WITH {'RECURSIVE ' if own else ''}{', '.join(parts)} " if used else "") + body


def rounded(columns: str, digits: int = 6) -> str:
    """Columns of doubles, each rounded; ``a b`` gives ``round(a, 6) AS a, round(b, 6) AS b``. Zero has no sign."""
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns.split())
