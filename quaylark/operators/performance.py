"""Ranking of keys: returns, scores and a weighted composite, one row a key."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaylark.functions.columns import bands, flag, latest, pct_change, rounded, series, trailing
from quaylark.operators.ranks import percent_ranks, row_numbers

# Composite weights, category steps and points of labels.
WEIGHTS = {"return_7": 0.20, "return_30": 0.20, "return_90": 0.20, "momentum": 0.10, "volatility": 0.10, "trend": 0.08, "macd": 0.07, "rsi": 0.05}
CATEGORY = ((75.0, "STRONG"), (55.0, "POSITIVE"), (40.0, "NEUTRAL"), (25.0, "WEAK"))


def lookbacks(bars: DataFrame, lags: tuple[int, ...] = (7, 30, 90, 252), year: int = 252, *, key: str = "ticker", ts: str = "date") -> DataFrame:
    """Latest row of each key with its returns, its year's high and low of the close, and
    its return since the key's first row."""
    w = series(key, ts)
    y = trailing(w, year)
    close = F.col("close")
    df = bars.withColumns({f"return_{n}d": pct_change(close, F.lag("close", n).over(w)) for n in lags} | {"high_52w": F.max("close").over(y), "low_52w": F.min("close").over(y), "first_close": F.first("close").over(w), "first_date": F.first(ts).over(w)})
    df = latest(df, key, [F.col(ts).desc()])
    return df.withColumns({"total_return": pct_change(close, F.col("first_close")), "from_high_pct": pct_change(close, F.col("high_52w")), "from_low_pct": pct_change(close, F.col("low_52w"))})


def _points(col: str, points: Mapping[str, float]) -> Column:
    out = None
    for label, p in points.items():
        out = F.when(F.col(col) == label, p) if out is None else out.when(F.col(col) == label, p)
    return out.otherwise(50.0)


def performance(metrics: DataFrame, indicators: DataFrame, companies: DataFrame, *, weights: Mapping[str, float] = WEIGHTS, key: str = "ticker", ts: str = "date") -> DataFrame:
    """One row for each key of metrics: returns, scores from 0 to 100, composite, rank,
    category. A key without a value has that percent-rank score 50 and no other key's
    score depends on it; ties in the composite are ranked by key."""
    market = lookbacks(metrics, key=key, ts=ts).select(key, ts, "close", "return_7d", "return_30d", "return_90d", "return_252d", "high_52w", "low_52w", "first_date", "total_return", "from_high_pct", "from_low_pct", "volatility")
    tech = latest(indicators, key, [F.col(ts).desc()]).select(key, F.col(ts).alias("technical_date"), "rsi_14", "momentum_10_pct", "trend_signal", "rsi_signal", "macd_state")
    df = market.join(tech, key, "left").join(companies.select(key, F.trim("name").alias("company_name")), key, "left")
    df = df.withColumn("dates_agree", flag(F.col(ts) == F.col("technical_date")))
    df = percent_ranks(df, {"score_return_7": ("return_7d", True), "score_return_30": ("return_30d", True), "score_return_90": ("return_90d", True), "score_momentum": ("momentum_10_pct", True), "score_volatility": ("volatility", False)})
    df = df.withColumns({c: F.coalesce(c, F.lit(50.0)) for c in ("score_return_7", "score_return_30", "score_return_90", "score_momentum", "score_volatility")})
    df = df.withColumns({
        "score_trend": _points("trend_signal", {"BULLISH": 100.0, "BEARISH": 0.0}),
        "score_macd": _points("macd_state", {"BULLISH": 100.0, "BEARISH": 0.0}),
        "score_rsi": _points("rsi_signal", {"NEUTRAL": 100.0, "OVERSOLD": 60.0, "OVERBOUGHT": 40.0}),
    })
    df = df.withColumn("composite", sum((F.col(f"score_{n}") * x for n, x in weights.items()), F.lit(0.0)))
    df = df.withColumn("category", bands(F.col("composite"), CATEGORY, "VERY_WEAK"))
    df = row_numbers(df, [F.round("composite", 9).desc(), F.col(key)], "performance_rank")
    return rounded(df, {c: 4 for c in ("close", "return_7d", "return_30d", "return_90d", "return_252d", "high_52w", "low_52w", "total_return", "from_high_pct", "from_low_pct", "rsi_14", "momentum_10_pct", "score_return_7", "score_return_30", "score_return_90", "score_momentum", "score_volatility", "composite")} | {"volatility": 6})
