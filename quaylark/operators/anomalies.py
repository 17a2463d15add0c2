"""Explainable anomaly events from rows before the current one."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaylark.functions.columns import bands, flag, full, pct_change, ratio, rounded, series, trailing, zscore

# Thresholds, score weights, severity steps and labels.
THRESHOLDS = {"return": 3.0, "volume": 3.0, "volume_ratio": 2.0, "range": 3.0, "gap": 3.0, "transactions": 3.0, "volatility": 1.5}
WEIGHTS = {"return": 30.0, "volume": 20.0, "range": 15.0, "gap": 15.0, "transactions": 10.0, "volatility": 10.0}
SEVERITY = ((80.0, "CRITICAL"), (65.0, "HIGH"), (50.0, "MEDIUM"))
SIGNALS = {"return": "PRICE_RETURN", "volume": "VOLUME", "range": "INTRADAY_RANGE", "gap": "OPENING_GAP", "transactions": "TRANSACTIONS", "volatility": "VOLATILITY"}


def _rsi_before(n: int, gain: Column, loss: Column, frame) -> Column:
    """Relative strength from plain means of the n rows before; 100 where nothing was lost."""
    up, down = F.avg(gain).over(frame), F.avg(loss).over(frame)
    return full(F.when(down == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + up / F.when(down != 0, down))), gain, n, frame)


def anomalies(metrics: DataFrame, *, key: str = "ticker", ts: str = "date", baseline: int = 30, thresholds: Mapping[str, float] = THRESHOLDS, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """metrics (unrounded) with z-scores against the `baseline` rows before, flags, score,
    decision, severity, explanation and market condition.

    A baseline is known only when all its rows are non-null; unknown z-scores raise no
    flag and score 0.
    """
    w = series(key, ts)
    before = trailing(w, baseline, current=False)
    close, prev = F.col("close"), F.col("previous_close")
    change = close - prev
    df = metrics.withColumns({
        "gap_pct": ratio(F.col("open") - prev, prev, positive=True) * 100,
        "return_7d": pct_change(close, F.lag("close", 7).over(w)),
        "return_20d": pct_change(close, F.lag("close", 20).over(w)),
        "return_30d": pct_change(close, F.lag("close", 30).over(w)),
        "mean_20_before": full(F.avg("close").over(trailing(w, 20, current=False)), close, 20, trailing(w, 20, current=False)),
        "high_60": F.max("close").over(trailing(w, 60)),
        "gain": F.when(prev.isNotNull(), F.greatest(change, F.lit(0.0))),
        "loss": F.when(prev.isNotNull(), F.greatest(-change, F.lit(0.0))),
    })
    series_of = {"return": F.col("daily_return"), "volume": F.col("volume"), "range": F.col("range_pct"), "gap": F.col("gap_pct"), "transactions": F.col("transactions").cast("double")}
    stats = {}
    for name, col in series_of.items():
        stats[f"{name}_mean"] = full(F.avg(col).over(before), col, baseline, before)
        stats[f"{name}_std"] = full(F.stddev_samp(col).over(before), col, baseline, before)
    stats["volatility_mean"] = full(F.avg("volatility").over(before), F.col("volatility"), baseline, before)
    stats["rsi"] = _rsi_before(14, F.col("gain"), F.col("loss"), trailing(w, 14, current=False))
    df = df.withColumns(stats)
    df = df.withColumns({f"{n}_z": zscore(c, F.col(f"{n}_mean"), F.col(f"{n}_std")) for n, c in series_of.items()} | {
        "volume_to_baseline": ratio(F.col("volume"), F.col("volume_mean"), positive=True),
        "volatility_ratio": ratio(F.col("volatility"), F.col("volatility_mean"), positive=True),
        "mean_20_distance_pct": pct_change(close, F.col("mean_20_before")),
        "drawdown_60_pct": pct_change(close, F.col("high_60")),
    })
    t = thresholds
    df = df.withColumns({
        "is_return": flag(F.abs("return_z") >= t["return"]),
        "is_volume": flag((F.col("volume_z") >= t["volume"])) | flag(F.col("volume_to_baseline") >= t["volume_ratio"]),
        "is_range": flag(F.col("range_z") >= t["range"]),
        "is_gap": flag(F.abs("gap_z") >= t["gap"]),
        "is_transactions": flag(F.col("transactions_z") >= t["transactions"]),
        "is_volatility": flag(F.col("volatility_ratio") >= t["volatility"]),
    })
    score = F.lit(0.0)
    for n in ("return", "volume", "range", "gap", "transactions"):
        score = score + F.coalesce(F.when(F.col(f"{n}_z").isNotNull(), F.least(F.abs(f"{n}_z") / 4, F.lit(1.0))) * weights[n], F.lit(0.0))
    score = score + F.coalesce(F.when(F.col("volatility_ratio").isNotNull(), F.least(F.greatest(F.col("volatility_ratio") - 1, F.lit(0.0)), F.lit(1.0))) * weights["volatility"], F.lit(0.0))
    fired = [F.col(f"is_{n}") for n in SIGNALS]
    count = sum((f.cast("int") for f in fired), F.lit(0))
    df = df.withColumns({"anomaly_score": score, "signal_count": count})
    df = df.withColumn("is_anomaly", (F.col("anomaly_score") >= SEVERITY[-1][0]) | (F.col("signal_count") >= 2))
    names = F.concat_ws(",", *[F.when(F.col(f"is_{n}"), label) for n, label in SIGNALS.items()])
    df = df.withColumns({
        "severity": bands(F.col("anomaly_score"), SEVERITY).when(F.col("is_anomaly"), "LOW").otherwise("NORMAL"),
        "explanation": F.when(~F.col("is_anomaly"), "NONE").when(names == "", "COMPOSITE_MULTI_FACTOR").otherwise(names),
        "market_condition": F.when(F.col("is_anomaly") & (F.col("daily_return") > 0), "ABNORMAL_UP_MOVE").when(F.col("is_anomaly") & (F.col("daily_return") < 0), "ABNORMAL_DOWN_MOVE")
        .when(F.col("rsi") >= 70, "OVERBOUGHT").when(F.col("rsi") <= 30, "OVERSOLD").when(F.col("daily_return") > 0, "NORMAL_UP").when(F.col("daily_return") < 0, "NORMAL_DOWN").otherwise("NEUTRAL"),
        "event_id": F.sha2(F.concat_ws("|", F.col(key), F.col(ts).cast("string")), 256),
    })
    return df


#: Digits of what is shown.
DIGITS = {c: 4 for c in ("gap_pct", "return_7d", "return_20d", "return_30d", "mean_20_distance_pct", "drawdown_60_pct", "rsi", "return_z", "volume_z", "range_z", "gap_z", "transactions_z", "volume_to_baseline", "volatility_ratio", "anomaly_score")}


def shown(df: DataFrame) -> DataFrame:
    return rounded(df, DIGITS)


def by_key(df: DataFrame, *, key: str = "ticker") -> DataFrame:
    """Rows, anomalies, average and highest score of each key, and its rows of each severity."""
    hit = F.col("is_anomaly")
    per = [F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "NORMAL")]
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(hit).alias("n_anomalies"), F.round(F.avg(F.when(hit, F.col("anomaly_score"))), 4).alias("avg_score"), F.round(F.max("anomaly_score"), 4).alias("max_score"), *per)


def strongest(df: DataFrame, n: int = 30) -> DataFrame:
    """The n strongest events: by score, then size of the return, then key and date."""
    return df.where("is_anomaly").orderBy(F.col("anomaly_score").desc(), F.abs("daily_return").desc(), "ticker", "date").limit(n)


def newest(df: DataFrame, n: int = 30) -> DataFrame:
    return df.where("is_anomaly").orderBy(F.col("date").desc(), F.col("anomaly_score").desc(), "ticker").limit(n)
