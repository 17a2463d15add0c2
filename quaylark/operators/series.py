"""Daily metrics of keyed time series. One exchange and one sort serve every frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylark.functions.columns import full, latest, ratio, rounded, series, trailing

#: Digits of the results; rounding is the last step.
DIGITS = {c: 4 for c in ("previous_close", "price_change", "daily_return_pct", "ma_short", "ma_long", "volume_avg", "volume_ratio", "range_pct", "close_vs_vwap_pct", "annual_volatility_pct")} | {c: 6 for c in ("daily_return", "log_return", "volatility", "annual_volatility")}


def daily_metrics(bars: DataFrame, *, key: str = "ticker", ts: str = "date", short: int = 7, long: int = 30, year: int = 252, digits: dict[str, int] | None = None) -> DataFrame:
    """bars with returns, moving averages, volatility and labels. Windows count rows, not
    days; a windowed value is null until its window is full of non-null values."""
    w = series(key, ts)
    close, prev = F.col("close"), F.col("previous_close")
    df = bars.withColumn("previous_close", F.lag("close").over(w))
    df = df.withColumns({
        "price_change": close - prev,
        "daily_return": ratio(close - prev, prev),
        "log_return": F.when((close > 0) & (prev > 0), F.log(close / prev)),
    })
    s, l = trailing(w, short), trailing(w, long)
    df = df.withColumns({
        "obs_short": F.count("close").over(s),
        "obs_long": F.count("close").over(l),
        "ma_short": full(F.avg("close").over(s), close, short, s),
        "ma_long": full(F.avg("close").over(l), close, long, l),
        "volume_avg": full(F.avg("volume").over(l), F.col("volume"), long, l),
        "volatility": full(F.stddev_samp("daily_return").over(l), F.col("daily_return"), long, l),
    })
    df = df.withColumns({
        "daily_return_pct": F.col("daily_return") * 100,
        "volume_ratio": ratio(F.col("volume"), F.col("volume_avg"), positive=True),
        "annual_volatility": F.col("volatility") * F.sqrt(F.lit(float(year))),
        "annual_volatility_pct": F.col("volatility") * F.sqrt(F.lit(float(year))) * 100,
        "range_pct": ratio(F.col("high") - F.col("low"), F.col("open"), positive=True) * 100,
        "close_vs_vwap_pct": ratio(close - F.col("vwap"), F.col("vwap"), positive=True) * 100,
        "direction": F.when(close > prev, "UP").when(close < prev, "DOWN").when(close == prev, "FLAT"),
    })
    return rounded(df, DIGITS if digits is None else digits)


def latest_per_key(df: DataFrame, *, key: str = "ticker", ts: str = "date") -> DataFrame:
    return latest(df, key, [F.col(ts).desc()])


def null_statistics(df: DataFrame, columns: list[str], *, key: str = "ticker") -> DataFrame:
    """Rows and nulls of each column, per key, in one pass."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns])
