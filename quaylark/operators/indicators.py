"""Technical indicators: windows where they suffice, affine scans for recursive ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylark.functions.columns import clean_number, full, ratio, rounded, series, trailing
from quaylark.operators.recursive import affine_scan, ema_step, mixed_ema_step, wilder_step

DIGITS = {c: 4 for c in ("sma_20", "sma_50", "ema_12", "ema_26", "rsi_14", "macd", "macd_signal", "macd_histogram", "bollinger_middle", "bollinger_upper", "bollinger_lower", "bollinger_width_pct", "bollinger_position", "momentum_10_pct", "price_vs_sma_20_pct", "price_vs_sma_50_pct")}


def indicators(bars: DataFrame, *, key: str = "ticker", ts: str = "date", sma: tuple[int, int] = (20, 50), ema: tuple[int, int] = (12, 26), signal: int = 9, rsi: int = 14, bollinger: int = 20, momentum: int = 10, chunk: int | None = None) -> DataFrame:
    """key, ts, close and the indicators, unrounded. Each is null until it is warm: a window
    until it is full, an exponential average of span n until row n, Wilder's RSI until
    n changes are seen, the MACD signal until its own span is full."""
    w = series(key, ts)
    rank, close = F.col("_rank"), F.col("close")
    options = {} if chunk is None else {"chunk": chunk}
    df = bars.select(key, ts, "close").withColumns({"_rank": F.row_number().over(w), "_change": close - F.lag("close").over(w)})
    df = df.withColumns({"_gain": F.greatest(F.col("_change"), F.lit(0.0)), "_loss": F.greatest(-F.col("_change"), F.lit(0.0))})
    df = df.withColumns({"_gain": F.when(F.col("_change").isNotNull(), F.col("_gain")), "_loss": F.when(F.col("_change").isNotNull(), F.col("_loss"))})
    seeds = trailing(w, rsi)
    df = df.withColumns({"_g": F.avg("_gain").over(seeds), "_l": F.avg("_loss").over(seeds)})
    fast, slow = ema
    df = affine_scan(df, {
        "_fast": ema_step(close, fast, rank), "_slow": ema_step(close, slow, rank),
        "_up": wilder_step(F.col("_gain"), F.col("_g"), rsi, rank, rsi + 1), "_down": wilder_step(F.col("_loss"), F.col("_l"), rsi, rank, rsi + 1),
        "_signal": mixed_ema_step({"_fast": 1.0, "_slow": -1.0}, signal, rank, slow),
    }, key=key, ts=ts, **options)
    df = df.withColumn("macd", F.when(rank >= slow, F.col("_fast") - F.col("_slow")))
    b, s1, s2 = trailing(w, bollinger), *(trailing(w, n) for n in sma)
    up, down = F.col("_up"), F.col("_down")
    df = df.withColumns({
        f"sma_{sma[0]}": full(F.avg("close").over(s1), close, sma[0], s1),
        f"sma_{sma[1]}": full(F.avg("close").over(s2), close, sma[1], s2),
        f"ema_{fast}": F.when(rank >= fast, F.col("_fast")),
        f"ema_{slow}": F.when(rank >= slow, F.col("_slow")),
        f"rsi_{rsi}": F.when((up == 0) & (down == 0), 50.0).when(down == 0, 100.0).when(down > 0, 100 - 100 / (1 + up / down)),
        "macd_signal": F.when(rank >= slow + signal - 1, F.col("_signal")),
        "bollinger_middle": full(F.avg("close").over(b), close, bollinger, b),
        "_std": full(F.stddev_samp("close").over(b), close, bollinger, b),
        f"momentum_{momentum}_pct": (ratio(close, F.lag("close", momentum).over(w)) - 1) * 100,
    })
    mid, std = F.col("bollinger_middle"), F.col("_std")
    df = df.withColumns({"macd_histogram": F.col("macd") - F.col("macd_signal"), "bollinger_upper": mid + 2 * std, "bollinger_lower": mid - 2 * std})
    low, high = F.col("bollinger_lower"), F.col("bollinger_upper")
    a, z = F.col(f"sma_{sma[0]}"), F.col(f"sma_{sma[1]}")
    r, m, g = F.col(f"rsi_{rsi}"), F.col("macd"), F.col("macd_signal")
    df = df.withColumns({
        "bollinger_width_pct": ratio(high - low, mid) * 100,
        "bollinger_position": ratio(close - low, high - low),
        f"price_vs_sma_{sma[0]}_pct": (ratio(close, a) - 1) * 100,
        f"price_vs_sma_{sma[1]}_pct": (ratio(close, z) - 1) * 100,
        "trend_signal": F.when(z.isNull(), None).when((close > a) & (a > z), "BULLISH").when((close < a) & (a < z), "BEARISH").otherwise("NEUTRAL"),
        "rsi_signal": F.when(r.isNull(), None).when(r >= 70, "OVERBOUGHT").when(r <= 30, "OVERSOLD").otherwise("NEUTRAL"),
        "macd_state": F.when(m.isNull() | g.isNull(), None).when(m > g, "BULLISH").when(m < g, "BEARISH").otherwise("NEUTRAL"),
    })
    numbers = [c for c, t in df.dtypes if t == "double" and not c.startswith("_")]
    return df.withColumns({c: clean_number(F.col(c)) for c in numbers}).select(*[c for c in df.columns if not c.startswith("_")])


def shown(df: DataFrame) -> DataFrame:
    return rounded(df, DIGITS)
