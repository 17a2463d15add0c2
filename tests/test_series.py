import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quaylark.operators import anomalies, indicators, series
from quaylark.operators.performance import percent_ranks
from quaylark.operators.recursive import affine_scan, ema_step


def bars(spark, closes, ticker="A"):
    day = dt.date(2020, 1, 1)
    return spark.createDataFrame([(ticker, day + dt.timedelta(i), float(c), float(c) + 1, float(c) - 1, float(c), 100.0 + i % 7, float(c), 10 + i % 5) for i, c in enumerate(closes)], "ticker string, date date, open double, high double, low double, close double, volume double, vwap double, transactions long")


def test_windows_are_null_until_full(spark):
    got = series.daily_metrics(bars(spark, range(10, 50))).orderBy("date").collect()
    assert [r["ma_short"] is None for r in got[:8]] == [True] * 6 + [False] * 2
    assert got[29]["ma_long"] is not None and got[28]["ma_long"] is None
    assert got[30]["volatility"] is not None and got[29]["volatility"] is None
    assert got[0]["direction"] is None and got[1]["direction"] == "UP"


def test_zero_and_null_prices_give_null_returns(spark):
    df = bars(spark, [1, 0, 2]).withColumn("close", F.when(F.col("close") != 2, F.col("close")))
    got = series.daily_metrics(df).orderBy("date").collect()
    assert [r["daily_return"] for r in got] == [None, -1.0, None]
    assert got[1]["log_return"] is None


@pytest.mark.parametrize("chunk", [3, 10, 8192])
def test_chunked_scan_equals_pandas(spark, chunk):
    x = np.random.default_rng(1).normal(size=100)
    df = bars(spark, x).withColumn("rank", F.datediff("date", F.lit("2020-01-01")) + 1)
    got = affine_scan(df, {"y": ema_step(F.col("close"), 12, F.col("rank"))}, chunk=chunk).orderBy("date").toPandas()["y"]
    assert np.allclose(got, pd.Series(x).ewm(span=12, adjust=False).mean(), atol=1e-12)


def test_flat_series(spark):
    got = indicators.indicators(bars(spark, [5] * 60)).orderBy("date").collect()
    assert got[-1]["rsi_14"] == 50.0 and got[-1]["bollinger_position"] is None and got[-1]["macd_state"] == "NEUTRAL"
    assert [i for i, r in enumerate(got) if r["macd_signal"] is not None][0] == 33
    assert [i for i, r in enumerate(got) if r["rsi_14"] is not None][0] == 14
    e = anomalies.anomalies(series.daily_metrics(bars(spark, [5] * 60), digits={})).orderBy("date").collect()
    assert e[-1]["rsi"] == 100.0 and e[-1]["return_z"] is None and e[-1]["severity"] == "NORMAL"


def test_spike_is_an_anomaly_after_warm_up(spark):
    x = [100 + (i % 3) * 0.1 for i in range(70)]
    x[10], x[65] = 150, 150
    got = anomalies.anomalies(series.daily_metrics(bars(spark, x), digits={})).orderBy("date").collect()
    assert not got[10]["is_anomaly"] and got[65]["is_return"] and got[65]["market_condition"] == "ABNORMAL_UP_MOVE"


def test_percent_rank_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", 3.0), ("e", None)], "k string, v double")
    got = {r["k"]: r["s"] for r in percent_ranks(df, {"s": ("v", True)}).collect()}
    assert got == {"a": 0.0, "b": pytest.approx(100 / 3), "c": pytest.approx(100 / 3), "d": 100.0, "e": None}


def test_empty_table(spark):
    assert series.daily_metrics(bars(spark, [1]).limit(0)).count() == 0
    assert indicators.indicators(bars(spark, [1]).limit(0)).count() == 0
