"""Queries over daily series: metrics, indicators, performance and anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylark.operators import anomalies as an
from quaylark.operators import indicators as ti
from quaylark.operators import performance as pf
from quaylark.operators.series import DIGITS, daily_metrics, latest_per_key, null_statistics
from quaylark.plans.catalog import register
from quaylark.sources import fixtures as fx

METRIC_COLUMNS = ["obs_short", "obs_long", "direction", *DIGITS]


def r(expr: str, n: int) -> str:
    """DuckDB: round half up on the decimal rendering with nine digits."""
    return f"CAST(round(CAST({expr} AS DECIMAL(38, 9)), {n}) AS DOUBLE)"


def metrics(spark: SparkSession, sf_dir: str, digits: dict | None = None) -> DataFrame:
    return daily_metrics(fx.bars(spark, sf_dir), digits=digits)


def raw_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir, {})


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir).select("ticker", "date", *METRIC_COLUMNS)


def latest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_per_key(metrics(spark, sf_dir)).select("ticker", "date", *METRIC_COLUMNS)


def null_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return null_statistics(metrics(spark, sf_dir), ["ma_short", "ma_long", "volatility", "previous_close"])


METRICS = fx.BARS + """,
m1 AS (SELECT *, lag(close) OVER w AS previous_close FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
m2 AS (
  SELECT *, close - previous_close AS price_change, CASE WHEN previous_close <> 0 THEN (close - previous_close) / previous_close END AS daily_return,
    CASE WHEN close > 0 AND previous_close > 0 THEN ln(close / previous_close) END AS log_return FROM m1),
m3 AS (
  SELECT *, count(close) OVER s AS obs_short, count(close) OVER l AS obs_long,
    CASE WHEN count(close) OVER s = 7 THEN avg(close) OVER s END AS ma_short,
    CASE WHEN count(close) OVER l = 30 THEN avg(close) OVER l END AS ma_long,
    CASE WHEN count(volume) OVER l = 30 THEN avg(volume) OVER l END AS volume_avg,
    CASE WHEN count(daily_return) OVER l = 30 THEN stddev_samp(daily_return) OVER l END AS volatility
  FROM m2 WINDOW s AS (PARTITION BY ticker ORDER BY date ROWS 6 PRECEDING), l AS (PARTITION BY ticker ORDER BY date ROWS 29 PRECEDING)),
metrics AS (
  SELECT *, daily_return * 100 AS daily_return_pct, CASE WHEN volume_avg > 0 THEN volume / volume_avg END AS volume_ratio,
    volatility * sqrt(252.0) AS annual_volatility, volatility * sqrt(252.0) * 100 AS annual_volatility_pct,
    CASE WHEN open > 0 THEN (high - low) / open * 100 END AS range_pct, CASE WHEN vwap > 0 THEN (close - vwap) / vwap * 100 END AS close_vs_vwap_pct,
    CASE WHEN close > previous_close THEN 'UP' WHEN close < previous_close THEN 'DOWN' WHEN close = previous_close THEN 'FLAT' END AS direction
  FROM m3)"""
_SHOWN = ", ".join(["ticker", "date", "obs_short", "obs_long", "direction"] + [f"{r(c, n)} AS {c}" for c, n in DIGITS.items()])

register("g_daily_metrics", daily, f"WITH {METRICS} SELECT {_SHOWN} FROM metrics")
register("g_latest_metrics", latest_metrics, f"WITH {METRICS} SELECT {_SHOWN} FROM metrics QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1")
register("g_null_statistics", null_stats, f"""WITH {METRICS} SELECT ticker, count(*) AS n_rows, count(*) FILTER (ma_short IS NULL) AS null_ma_short, count(*) FILTER (ma_long IS NULL) AS null_ma_long,
  count(*) FILTER (volatility IS NULL) AS null_volatility, count(*) FILTER (previous_close IS NULL) AS null_previous_close FROM metrics GROUP BY ticker""")


def technical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ti.shown(ti.indicators(fx.bars(spark, sf_dir))).drop("close")


INDICATORS = """
t1 AS (
  SELECT ticker, date, close, row_number() OVER w AS rn, close - lag(close) OVER w AS change, lag(close, 10) OVER w AS lag10,
    CASE WHEN row_number() OVER w >= 20 THEN avg(close) OVER f20 END AS sma_20, CASE WHEN row_number() OVER w >= 50 THEN avg(close) OVER f50 END AS sma_50,
    CASE WHEN row_number() OVER w >= 20 THEN stddev_samp(close) OVER f20 END AS std_20
  FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date), f20 AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING), f50 AS (PARTITION BY ticker ORDER BY date ROWS 49 PRECEDING)),
t2 AS (SELECT *, CASE WHEN change IS NOT NULL THEN greatest(change, 0.0) END AS gain, CASE WHEN change IS NOT NULL THEN greatest(-change, 0.0) END AS loss FROM t1),
t3 AS (SELECT *, avg(gain) OVER w AS g14, avg(loss) OVER w AS l14 FROM t2 WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 13 PRECEDING)),
fold AS (
  SELECT ticker, rn, close AS fast, close AS slow, CAST(NULL AS DOUBLE) AS up, CAST(NULL AS DOUBLE) AS down, CAST(NULL AS DOUBLE) AS sig FROM t3 WHERE rn = 1
  UNION ALL
  SELECT t.ticker, t.rn, f.fast * (1 - 2.0 / 13) + t.close * (2.0 / 13), f.slow * (1 - 2.0 / 27) + t.close * (2.0 / 27),
    CASE WHEN t.rn = 15 THEN g14 WHEN t.rn > 15 THEN f.up * (13.0 / 14) + gain / 14 END,
    CASE WHEN t.rn = 15 THEN l14 WHEN t.rn > 15 THEN f.down * (13.0 / 14) + loss / 14 END,
    CASE WHEN t.rn = 26 THEN (f.fast * (1 - 2.0 / 13) + t.close * (2.0 / 13)) - (f.slow * (1 - 2.0 / 27) + t.close * (2.0 / 27))
      WHEN t.rn > 26 THEN f.sig * 0.8 + 0.2 * ((f.fast * (1 - 2.0 / 13) + t.close * (2.0 / 13)) - (f.slow * (1 - 2.0 / 27) + t.close * (2.0 / 27))) END
  FROM fold f JOIN t3 t ON t.ticker = f.ticker AND t.rn = f.rn + 1),
t4 AS (
  SELECT t.*, CASE WHEN rn >= 12 THEN fast END AS ema_12, CASE WHEN rn >= 26 THEN slow END AS ema_26, CASE WHEN rn >= 26 THEN fast - slow END AS macd,
    CASE WHEN up = 0 AND down = 0 THEN 50.0 WHEN down = 0 THEN 100.0 WHEN down > 0 THEN 100 - 100 / (1 + up / down) END AS rsi_14,
    CASE WHEN rn >= 34 THEN sig END AS macd_signal, sma_20 AS bollinger_middle, sma_20 + 2 * std_20 AS bollinger_upper, sma_20 - 2 * std_20 AS bollinger_lower
  FROM t3 t JOIN fold USING (ticker, rn)),
indicators AS (
  SELECT *, macd - macd_signal AS macd_histogram, CASE WHEN sma_20 <> 0 THEN (bollinger_upper - bollinger_lower) / sma_20 * 100 END AS bollinger_width_pct,
    CASE WHEN bollinger_upper <> bollinger_lower THEN (close - bollinger_lower) / (bollinger_upper - bollinger_lower) END AS bollinger_position,
    CASE WHEN lag10 <> 0 THEN (close / lag10 - 1) * 100 END AS momentum_10_pct,
    (close / sma_20 - 1) * 100 AS price_vs_sma_20_pct, (close / sma_50 - 1) * 100 AS price_vs_sma_50_pct,
    CASE WHEN sma_50 IS NULL THEN NULL WHEN close > sma_20 AND sma_20 > sma_50 THEN 'BULLISH' WHEN close < sma_20 AND sma_20 < sma_50 THEN 'BEARISH' ELSE 'NEUTRAL' END AS trend_signal,
    CASE WHEN rsi_14 IS NULL THEN NULL WHEN rsi_14 >= 70 THEN 'OVERBOUGHT' WHEN rsi_14 <= 30 THEN 'OVERSOLD' ELSE 'NEUTRAL' END AS rsi_signal,
    CASE WHEN macd IS NULL OR macd_signal IS NULL THEN NULL WHEN macd > macd_signal THEN 'BULLISH' WHEN macd < macd_signal THEN 'BEARISH' ELSE 'NEUTRAL' END AS macd_state
  FROM t4)"""
register("t_indicators", technical, f"WITH RECURSIVE {fx.BARS}, {INDICATORS} SELECT ticker, date, trend_signal, rsi_signal, macd_state, " + ", ".join(f"{r(c, n)} AS {c}" for c, n in ti.DIGITS.items()) + " FROM indicators")


def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = fx.bars(spark, sf_dir)
    return pf.performance(daily_metrics(bars, digits={}), ti.indicators(bars), fx.companies(spark, sf_dir))


def _rank_sql(out: str, col: str, way: str) -> str:
    return f"CASE WHEN {col} IS NOT NULL THEN 100 * percent_rank() OVER (PARTITION BY {col} IS NULL ORDER BY {col} {way}) ELSE 50.0 END AS {out}"


PERFORMANCE = """
look AS (
  SELECT *, lag(close, 7) OVER w AS l7, lag(close, 30) OVER w AS l30, lag(close, 90) OVER w AS l90, lag(close, 252) OVER w AS l252,
    max(close) OVER y AS high_52w, min(close) OVER y AS low_52w, first(close) OVER w AS first_close, first(date) OVER w AS first_date
  FROM metrics WINDOW w AS (PARTITION BY ticker ORDER BY date), y AS (PARTITION BY ticker ORDER BY date ROWS 251 PRECEDING)
  QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1),
tech AS (SELECT ticker, date AS technical_date, rsi_14, momentum_10_pct, trend_signal, rsi_signal, macd_state FROM indicators QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1),
p1 AS (
  SELECT look.ticker, look.date, close, (close / l7 - 1) * 100 AS return_7d, (close / l30 - 1) * 100 AS return_30d, (close / l90 - 1) * 100 AS return_90d, (close / l252 - 1) * 100 AS return_252d,
    high_52w, low_52w, first_date, (close / first_close - 1) * 100 AS total_return, (close / high_52w - 1) * 100 AS from_high_pct, (close / low_52w - 1) * 100 AS from_low_pct, volatility,
    technical_date, rsi_14, momentum_10_pct, trend_signal, rsi_signal, macd_state, trim(name) AS company_name, coalesce(look.date = technical_date, false) AS dates_agree
  FROM look LEFT JOIN tech USING (ticker) LEFT JOIN companies ON companies.ticker = look.ticker),
p2 AS (SELECT *, """ + ", ".join(_rank_sql(*x) for x in (("score_return_7", "return_7d", "ASC"), ("score_return_30", "return_30d", "ASC"), ("score_return_90", "return_90d", "ASC"), ("score_momentum", "momentum_10_pct", "ASC"), ("score_volatility", "volatility", "DESC"))) + """,
    CASE trend_signal WHEN 'BULLISH' THEN 100.0 WHEN 'BEARISH' THEN 0.0 ELSE 50.0 END AS score_trend, CASE macd_state WHEN 'BULLISH' THEN 100.0 WHEN 'BEARISH' THEN 0.0 ELSE 50.0 END AS score_macd,
    CASE rsi_signal WHEN 'NEUTRAL' THEN 100.0 WHEN 'OVERSOLD' THEN 60.0 WHEN 'OVERBOUGHT' THEN 40.0 ELSE 50.0 END AS score_rsi FROM p1),
p3 AS (SELECT *, """ + " + ".join(f"{x} * score_{n}" for n, x in pf.WEIGHTS.items()) + """ AS composite FROM p2),
perf AS (SELECT *, row_number() OVER (ORDER BY round(composite, 9) DESC, ticker) AS performance_rank,
    CASE WHEN composite >= 75 THEN 'STRONG' WHEN composite >= 55 THEN 'POSITIVE' WHEN composite >= 40 THEN 'NEUTRAL' WHEN composite >= 25 THEN 'WEAK' ELSE 'VERY_WEAK' END AS category FROM p3)"""
_ROUND4 = ("close", "return_7d", "return_30d", "return_90d", "return_252d", "high_52w", "low_52w", "total_return", "from_high_pct", "from_low_pct", "rsi_14", "momentum_10_pct", "score_return_7", "score_return_30", "score_return_90", "score_momentum", "score_volatility", "composite")
register("p_performance", ranking, f"WITH RECURSIVE {METRICS}, {fx.COMPANIES}, {INDICATORS}, {PERFORMANCE} SELECT ticker, date, first_date, technical_date, trend_signal, rsi_signal, macd_state, company_name, dates_agree, score_trend, score_macd, score_rsi, performance_rank, category, {r('volatility', 6)} AS volatility, " + ", ".join(f"{r(c, 4)} AS {c}" for c in _ROUND4) + " FROM perf")

EVENT_COLUMNS = ["ticker", "date", "event_id", "is_return", "is_volume", "is_range", "is_gap", "is_transactions", "is_volatility", "signal_count", "is_anomaly", "severity", "explanation", "market_condition"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.anomalies(raw_metrics(spark, sf_dir))


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.shown(events(spark, sf_dir)).select(*EVENT_COLUMNS, *an.DIGITS)


def _base(n: str, col: str) -> str:
    return f"CASE WHEN count({col}) OVER b = 30 THEN avg({col}) OVER b END AS {n}_mean, CASE WHEN count({col}) OVER b = 30 THEN stddev_samp({col}) OVER b END AS {n}_std"


_Z = {"return": "daily_return", "volume": "volume", "range": "range_pct", "gap": "gap_pct", "transactions": "transactions"}
ANOMALIES = """
a1 AS (
  SELECT *, CASE WHEN previous_close > 0 THEN (open - previous_close) / previous_close * 100 END AS gap_pct,
    (close / lag(close, 7) OVER w - 1) * 100 AS return_7d, (close / lag(close, 20) OVER w - 1) * 100 AS return_20d, (close / lag(close, 30) OVER w - 1) * 100 AS return_30d,
    CASE WHEN count(close) OVER p20 = 20 THEN avg(close) OVER p20 END AS mean_20_before, max(close) OVER f60 AS high_60,
    CASE WHEN previous_close IS NOT NULL THEN greatest(close - previous_close, 0.0) END AS gain, CASE WHEN previous_close IS NOT NULL THEN greatest(previous_close - close, 0.0) END AS loss
  FROM metrics WINDOW w AS (PARTITION BY ticker ORDER BY date), p20 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), f60 AS (PARTITION BY ticker ORDER BY date ROWS 59 PRECEDING)),
a2 AS (
  SELECT *, """ + ", ".join(_base(n, c) for n, c in _Z.items()) + """,
    CASE WHEN count(volatility) OVER b = 30 THEN avg(volatility) OVER b END AS volatility_mean,
    CASE WHEN count(gain) OVER p14 = 14 THEN CASE WHEN avg(loss) OVER p14 = 0 THEN 100.0 ELSE 100 - 100 / (1 + avg(gain) OVER p14 / avg(loss) OVER p14) END END AS rsi
  FROM a1 WINDOW b AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), p14 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)),
a3 AS (
  SELECT *, """ + ", ".join(f"CASE WHEN {n}_std > 0 THEN ({c} - {n}_mean) / {n}_std END AS {n}_z" for n, c in _Z.items()) + """,
    CASE WHEN volume_mean > 0 THEN volume / volume_mean END AS volume_to_baseline, CASE WHEN volatility_mean > 0 THEN volatility / volatility_mean END AS volatility_ratio,
    (close / mean_20_before - 1) * 100 AS mean_20_distance_pct, (close / high_60 - 1) * 100 AS drawdown_60_pct FROM a2),
a4 AS (
  SELECT *, coalesce(abs(return_z) >= 3, false) AS is_return, coalesce(volume_z >= 3, false) OR coalesce(volume_to_baseline >= 2, false) AS is_volume, coalesce(range_z >= 3, false) AS is_range,
    coalesce(abs(gap_z) >= 3, false) AS is_gap, coalesce(transactions_z >= 3, false) AS is_transactions, coalesce(volatility_ratio >= 1.5, false) AS is_volatility,
    """ + " + ".join(f"coalesce(CASE WHEN {n}_z IS NOT NULL THEN least(abs({n}_z) / 4, 1.0) * {an.WEIGHTS[n]} END, 0.0)" for n in _Z) + """
    + coalesce(CASE WHEN volatility_ratio IS NOT NULL THEN least(greatest(volatility_ratio - 1, 0.0), 1.0) * 10.0 END, 0.0) AS anomaly_score FROM a3),
a5 AS (SELECT *, CAST(is_return AS INT) + CAST(is_volume AS INT) + CAST(is_range AS INT) + CAST(is_gap AS INT) + CAST(is_transactions AS INT) + CAST(is_volatility AS INT) AS signal_count FROM a4),
a6 AS (SELECT *, anomaly_score >= 50 OR signal_count >= 2 AS is_anomaly,
    concat_ws(',', """ + ", ".join(f"CASE WHEN is_{n} THEN '{s}' END" for n, s in an.SIGNALS.items()) + """) AS names FROM a5),
anomalies AS (
  SELECT *, CASE WHEN anomaly_score >= 80 THEN 'CRITICAL' WHEN anomaly_score >= 65 THEN 'HIGH' WHEN anomaly_score >= 50 THEN 'MEDIUM' WHEN is_anomaly THEN 'LOW' ELSE 'NORMAL' END AS severity,
    CASE WHEN NOT is_anomaly THEN 'NONE' WHEN names = '' THEN 'COMPOSITE_MULTI_FACTOR' ELSE names END AS explanation,
    CASE WHEN is_anomaly AND daily_return > 0 THEN 'ABNORMAL_UP_MOVE' WHEN is_anomaly AND daily_return < 0 THEN 'ABNORMAL_DOWN_MOVE' WHEN rsi >= 70 THEN 'OVERBOUGHT' WHEN rsi <= 30 THEN 'OVERSOLD'
      WHEN daily_return > 0 THEN 'NORMAL_UP' WHEN daily_return < 0 THEN 'NORMAL_DOWN' ELSE 'NEUTRAL' END AS market_condition,
    sha256(ticker || '|' || CAST(date AS VARCHAR)) AS event_id FROM a6)"""
register("a_anomalies", event_rows, f"WITH {METRICS}, {ANOMALIES} SELECT {', '.join(EVENT_COLUMNS)}, " + ", ".join(f"{r(c, n)} AS {c}" for c, n in an.DIGITS.items()) + " FROM anomalies")
register("a_by_key", lambda s, d: an.by_key(events(s, d)), f"WITH {METRICS}, {ANOMALIES} SELECT ticker, count(*) AS n_rows, count(*) FILTER (is_anomaly) AS n_anomalies, {r('avg(anomaly_score) FILTER (is_anomaly)', 4)} AS avg_score, {r('max(anomaly_score)', 4)} AS max_score, " + ", ".join(f"count(*) FILTER (severity = '{x}') AS n_{x.lower()}" for x in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "NORMAL")) + " FROM anomalies GROUP BY ticker")
_TOP = f"SELECT ticker, date, severity, {r('anomaly_score', 4)} AS anomaly_score FROM anomalies WHERE is_anomaly ORDER BY"


def _top(df: DataFrame) -> DataFrame:
    return df.select("ticker", "date", "severity", F.round("anomaly_score", 4).alias("anomaly_score"))


register("a_strongest", lambda s, d: _top(an.strongest(events(s, d))), f"WITH {METRICS}, {ANOMALIES} {_TOP} anomalies.anomaly_score DESC, abs(daily_return) DESC, ticker, date LIMIT 30")
register("a_newest", lambda s, d: _top(an.newest(events(s, d))), f"WITH {METRICS}, {ANOMALIES} {_TOP} date DESC, anomalies.anomaly_score DESC, ticker LIMIT 30")
