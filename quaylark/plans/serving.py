"""Queries that serve readers, check quality, check reports, and run the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylark.functions.columns import latest
from quaylark.operators import indicators as ti
from quaylark.operators import quality as qa
from quaylark.operators import serving as sv
from quaylark.operators.context import dealt
from quaylark.plans.catalog import register
from quaylark.plans.market import ANOMALIES, METRICS, events, metrics, r, ranking, raw_metrics
from quaylark.plans.newsroom import ranked
from quaylark.sources import fixtures as fx
from quaylark.sources.shared import new_folder, stored
from quaylark.streaming import ingest as st


def _history(s: SparkSession, d: str) -> DataFrame:
    return sv.last_n(metrics(s, d), 30).select("ticker", "date", "place", "price_change", "ma_short")


register("q_history", _history, f"WITH {METRICS} SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS place, {r('price_change', 4)} AS price_change, {r('ma_short', 4)} AS ma_short FROM metrics QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 30")
register("q_anomaly_summary", lambda s, d: sv.anomaly_summary(events(s, d)), f"""WITH {METRICS}, {ANOMALIES} SELECT ticker, count(*) AS total, count(*) FILTER (severity = 'CRITICAL') AS critical_count, count(*) FILTER (severity = 'HIGH') AS high_count, count(*) FILTER (severity = 'MEDIUM') AS medium_count, count(*) FILTER (severity = 'LOW') AS low_count,
  {r('avg(anomaly_score)', 4)} AS avg_score, {r('max(anomaly_score)', 4)} AS max_score, max(date) AS latest_date, arg_max(severity, date) AS latest_severity FROM anomalies WHERE is_anomaly GROUP BY ticker""")
register("q_watchlist", lambda s, d: sv.watchlist_latest(fx.watchlist(s, d), metrics(s, d), ["price_change", "direction"]), f"""WITH {METRICS}, {fx.WATCHLIST}, n AS (SELECT ticker, date, price_change, direction FROM metrics QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1)
SELECT user_id, ticker, date, {r('price_change', 4)} AS price_change, direction, CASE WHEN date IS NULL THEN 'NOT_FOUND_IN_GOLD' ELSE 'OK' END AS status FROM watchlist LEFT JOIN n USING (ticker)""")
register("q_watchlist_users", lambda s, d: fx.watchlist(s, d).join(fx.table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name"), "user_id").orderBy("user_id", "ticker"), f"WITH {fx.WATCHLIST} SELECT user_id, ticker, c_name FROM watchlist JOIN customer ON c_custkey = user_id")


def reports(s: SparkSession, d: str) -> DataFrame:
    """One report a watched pair with bars: true, rounded and scaled numbers of its latest
    bar, a wrong one in every third, an unknown date in every fifth."""
    # The latest bars are as many as tickers; stored, so that whatever reads the reports makes them once.
    now = stored(latest(raw_metrics(s, d), "ticker", [F.col("date").desc()]).select("ticker", "date", "close", "volume"))
    m = sv.watchlist_latest(dealt(fx.watchlist(s, d)), now, ["close", "volume"]).where("status = 'OK'")
    m = m.withColumn("report_id", F.col("user_id") * 100 + F.substring("ticker", 7, 9).cast("int"))
    price, volume = F.col("close"), F.col("volume")
    text = F.concat(
        F.lit("Over 30 days "), "ticker", F.lit(" closed at "), F.format_string("%.2f", price), F.lit(" on "), F.col("date").cast("string"), F.lit(" with a volume of "), F.format_string("%.3fK", volume / 1000), F.lit(" – about "), F.format_string("%.0f", price),
        F.when(F.col("report_id") % 3 == 0, ". A rise to 987654.25 is due").otherwise(""), F.when(F.col("report_id") % 5 == 0, " on 2030-01-01.").otherwise("."),
    )
    document = F.to_json(F.struct("ticker", F.when(F.col("report_id") % 7 == 0, "MAYBE").otherwise("SUPPORTED").alias("stance"), F.array(F.lit("volatility")).alias("risks"), F.lit("No advice.").alias("disclaimer")))
    return m.select("report_id", "user_id", "ticker", "date", "close", "volume", text.alias("text"), document.alias("document"))


def _claims(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rep = stored(reports(s, d))
    values, _ = sv.source_values(rep.select("report_id", F.struct("date", "close", "volume").alias("bar")), ["report_id"])
    return rep, sv.ground(rep, values)


def verdict_rows(s: SparkSession, d: str) -> DataFrame:
    rep, claims = _claims(s, d)
    return sv.verdicts(rep, claims, rep.select("report_id", F.col("date").alias("day")))


_REP = f"""WITH {METRICS}, {fx.WATCHLIST}, n AS (SELECT ticker, close, volume FROM metrics QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1),
rep AS (SELECT user_id * 100 + CAST(substr(ticker, 7) AS INTEGER) AS report_id, user_id, ticker, close, volume FROM watchlist JOIN n USING (ticker)),
c AS (SELECT report_id, CAST(3 - (round(close, 0) IN (1, 7, 10, 14, 20, 30, 50, 52, 90, 365))::INT + (report_id % 3 = 0)::INT AS BIGINT) AS claims, CAST((report_id % 3 = 0)::INT AS BIGINT) AS ungrounded, (report_id % 5 = 0)::INT AS unknown_dates, report_id % 7 = 0 AS maybe FROM rep)"""
register("q_report_verdicts", verdict_rows, f"{_REP} SELECT report_id, claims, ungrounded, unknown_dates, concat_ws(',', CASE WHEN maybe THEN 'stance' END, CASE WHEN ungrounded > 0 THEN 'numbers' END, CASE WHEN unknown_dates > 0 THEN 'dates' END) AS errors, CASE WHEN maybe OR ungrounded > 0 OR unknown_dates > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM c")
register("q_report_history", lambda s, d: reports(s, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("reports"), F.max("report_id").alias("newest")), f"{_REP} SELECT user_id, count(*) AS reports, max(report_id) AS newest FROM rep GROUP BY user_id")
register("q_report_page", lambda s, d: sv.report_page(reports(s, d), 2, ts="date").select("user_id", "ticker", "report_id", "place"), f"{_REP.replace('ticker, close, volume FROM', 'ticker, date, close, volume FROM', 1).replace('user_id, ticker, close', 'user_id, ticker, date, close', 1)} SELECT user_id, ticker, report_id, row_number() OVER (PARTITION BY user_id ORDER BY date DESC, report_id DESC) AS place FROM rep QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY date DESC, report_id DESC) <= 2")


def quality(s: SparkSession, d: str) -> DataFrame:
    """The library's rules over its own outputs."""
    # Each of these tables is read by several rules and computed once.
    bars, m, e, tech, perf, rk = (stored(x) for x in (fx.bars(s, d), raw_metrics(s, d), events(s, d), ti.indicators(fx.bars(s, d)), ranking(s, d), ranked(s, d)))
    close, prev = F.col("close"), F.col("previous_close")
    return qa.verdict(s, [
        qa.non_empty("bars: not empty", bars), qa.unique("bars: one row a key and day", bars, ["ticker", "date"]),
        qa.row_rules(m, {
            "metrics: key known": F.col("ticker").isNull() | F.col("date").isNull(), "metrics: prices in order": (F.col("high") < F.col("low")) | (close <= 0),
            "metrics: change follows": F.abs(F.col("price_change") - (close - prev)) > 1e-3, "metrics: return follows": F.abs(F.col("daily_return") - (close / prev - 1)) > 1e-6,
            "metrics: direction follows": F.col("direction") != F.when(close > prev, "UP").when(close < prev, "DOWN").otherwise("FLAT"), "metrics: flat days": F.col("direction") == "FLAT",
        }),
        qa.row_rules(tech, {
            "indicators: rsi range": ~F.col("rsi_14").between(0, 100), "indicators: bands in order": (F.col("bollinger_lower") > F.col("bollinger_middle")) | (F.col("bollinger_middle") > F.col("bollinger_upper")),
            "indicators: histogram follows": F.abs(F.col("macd_histogram") - (F.col("macd") - F.col("macd_signal"))) > 1e-5, "indicators: trend domain": ~F.col("trend_signal").isin("BULLISH", "BEARISH", "NEUTRAL"),
        }),
        qa.row_rules(e, {
            "anomalies: score range": ~F.col("anomaly_score").between(0, 100), "anomalies: severity follows": (F.col("anomaly_score") >= 50) & F.col("severity").isin("LOW", "NORMAL"),
            "anomalies: counts add up": F.col("is_anomaly") & (F.col("severity") == "NORMAL"), "anomalies: warm-up": F.col("return_z").isNotNull() & (F.col("obs_long") < 30),
        }),
        qa.rate("anomalies: rate", e, F.col("is_anomaly"), 0.0, 10.0), qa.ranked("performance: ranks", perf, "performance_rank", []), qa.ranked("relevance: ranks", rk, "news_rank", ["event_id"]),
        qa.same_keys("keys: metrics and performance", m, perf, ["ticker"]), qa.same_keys("keys: bars and companies", bars, fx.companies(s, d), ["ticker"]), qa.refers("relevance: events exist", rk, e, ["event_id"]),
        qa.row_rules(rk, {"relevance: score range": ~F.col("relevance_score").between(0, 100), "relevance: weight range": ~F.col("temporal_weight").between(0, 1)}),
    ])


_FLAT = "metrics: flat days"
register("d_quality", quality, f"WITH {METRICS}, x AS (SELECT unnest(['bars: not empty', 'bars: one row a key and day', 'metrics: key known', 'metrics: prices in order', 'metrics: change follows', 'metrics: return follows', 'metrics: direction follows', 'indicators: rsi range', 'indicators: bands in order', 'indicators: histogram follows', 'indicators: trend domain', 'anomalies: score range', 'anomalies: severity follows', 'anomalies: counts add up', 'anomalies: warm-up', 'anomalies: rate', 'performance: ranks', 'relevance: ranks', 'keys: metrics and performance', 'relevance: events exist', 'relevance: score range', 'relevance: weight range']) AS rule, CAST(0 AS BIGINT) AS violations UNION ALL SELECT 'keys: bars and companies', 1 UNION ALL SELECT '{_FLAT}', count(*) FILTER (direction = 'FLAT') FROM metrics) SELECT *, violations = 0 AS passed FROM x UNION ALL SELECT 'ALL', count(*) FILTER (violations > 0), count(*) FILTER (violations > 0) = 0 FROM x")
_PAIRS = [("return_z", "volume_z"), ("return_z", "range_z"), ("volume_z", "transactions_z"), ("gap_z", "return_z")]
register("d_correlations", lambda s, d: qa.correlations(events(s, d), _PAIRS), f"WITH {METRICS}, {ANOMALIES} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})', 6)} AS r FROM anomalies" for a, b in _PAIRS))
_DIST = ["severity", "market_condition", "is_return", "is_volume"]
register("d_distributions", lambda s, d: qa.distribution(events(s, d), _DIST), f"WITH {METRICS}, {ANOMALIES} " + " UNION ALL ".join(f"SELECT '{c}' AS field, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM anomalies GROUP BY {c}" for c in _DIST))


def streamed(s: SparkSession, d: str) -> DataFrame:
    """The latest event of each user and type, by way of the stream."""
    folder, keys = new_folder(s, "stream"), ["user_id", "event_type"]
    source = fx.table(s, d, "events")
    source.repartitionByRange(16, "ts").write.parquet(f"{folder}/in")
    st.upsert_stream(st.read_events(s, f"{folder}/in", source.schema), f"{folder}/table", f"{folder}/state", keys).awaitTermination()
    return st.latest_state(s, f"{folder}/table", keys).select(*keys, "event_id", "k")


register("st_newest_events", streamed, "SELECT user_id, event_type, event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
