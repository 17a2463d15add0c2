"""Queries of cleaning, ingestion, intervals, the calendar and freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylark.operators import calendar as cal
from quaylark.operators import clean as cl
from quaylark.operators import ingest as ig
from quaylark.operators import intervals as iv
from quaylark.operators import news as nw
from quaylark.plans.catalog import register
from quaylark.plans.market import ANOMALIES, METRICS, events, r
from quaylark.plans.newsroom import REL
from quaylark.sources import fixtures as fx
from quaylark.sources import tables as tb

_I4 = ("intraday_change", "intraday_change_pct", "daily_range", "daily_range_pct")


def clean_prices(s: SparkSession, d: str) -> DataFrame:
    df = cl.judge(fx.bars(s, d).withColumn("high", F.when(F.dayofmonth("date") == 13, F.col("low") / 2).otherwise(F.col("high"))), cl.price_rules())
    return cl.intraday(df).select("ticker", "date", "valid", F.array_join("failed", ",").alias("failed"), *_I4)


register("c_clean_prices", clean_prices, f"""WITH {fx.BARS}, b AS (SELECT * REPLACE (CASE WHEN day(date) = 13 THEN low / 2 ELSE high END AS high) FROM bars),
j AS (SELECT *, concat_ws(',', CASE WHEN NOT (high >= open AND high >= low AND high >= close) THEN 'high_is_highest' END, CASE WHEN NOT (low <= open AND low <= high AND low <= close) THEN 'low_is_lowest' END) AS failed FROM b)
SELECT ticker, date, failed = '' AS valid, failed, {r('close - open', 4)} AS intraday_change, {r('(close - open) / open * 100', 4)} AS intraday_change_pct, {r('high - low', 4)} AS daily_range, {r('(high - low) / open * 100', 4)} AS daily_range_pct FROM j""")
register("c_normalise_prices", lambda s, d: cl.normalise_prices(fx.bars(s, d)).select("ticker", "date", *cl.PRICES, "vwap"), f"WITH {fx.BARS} SELECT upper(ticker) AS ticker, date, " + ", ".join(f"{r(c, 4)} AS {c}" for c in (*cl.PRICES, "vwap")) + " FROM bars")
register("c_company_features", lambda s, d: cl.company_features(fx.companies(s, d), fx.AS_OF).select("ticker", "name", "market_cap_billions", "years_listed", "total_employees", "valid"), f"""WITH {fx.BARS}, {fx.COMPANIES}
SELECT ticker, trim(name) AS name, {r('market_cap / 1e9', 4)} AS market_cap_billions, CAST(floor((date_diff('month', list_date, DATE '{fx.AS_OF}') - CASE WHEN day(list_date) > day(DATE '{fx.AS_OF}') THEN 1 ELSE 0 END) / 12.0) AS BIGINT) AS years_listed, total_employees, true AS valid FROM companies""")


def _versions(s: SparkSession, d: str) -> DataFrame:
    b = fx.bars(s, d).select("ticker", "date", "close")
    return b.withColumns({"part": F.datediff("date", F.lit("1990-01-01").cast("date")) % 3, "_ingested_at": F.lit("2001-12-01 00:00:00").cast("timestamp")})


def _target(s: SparkSession, d: str) -> DataFrame:
    return _versions(s, d).where("part in (0, 1)").drop("part")


def _update(s: SparkSession, d: str) -> DataFrame:
    """Changed closes: parts 1 and 2, on even days newer, else older than what is stored."""
    at = F.when(F.dayofmonth("date") % 2 == 0, F.lit("2001-12-02 00:00:00")).otherwise(F.lit("2001-11-30 00:00:00")).cast("timestamp")
    return _versions(s, d).where("part in (1, 2)").withColumns({"close": F.col("close") + 1, "_ingested_at": at}).drop("part")


def _upsert(mode: str):
    return lambda s, d: ig.upsert(_target(s, d), _update(s, d), ["ticker", "date"], mode=mode).select("ticker", "date", F.round(F.round("close", 9), 4).alias("close"))


_UP = f"WITH {fx.BARS}, v AS (SELECT ticker, date, close, (date - DATE '1990-01-01') % 3 AS part, day(date) % 2 = 0 AS newer FROM bars)"
register("s_upsert_last", _upsert("last"), f"{_UP} SELECT ticker, date, {r('CASE WHEN part IN (1, 2) THEN close + 1 ELSE close END', 4)} AS close FROM v")
register("s_upsert_newer", _upsert("newer"), f"{_UP} SELECT ticker, date, {r('CASE WHEN part = 2 OR (part = 1 AND newer) THEN close + 1 ELSE close END', 4)} AS close FROM v")
register("s_upsert_insert", _upsert("insert"), f"{_UP} SELECT ticker, date, {r('CASE WHEN part = 2 THEN close + 1 ELSE close END', 4)} AS close FROM v")
register("s_last_in_batch", lambda s, d: ig.last_in_batch(fx.table(s, d, "events").select("user_id", "event_type", "event_id", F.round("value", 6).alias("value")), ["user_id", "event_type"], "event_id"),
         "SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
register("s_fetch_plan", lambda s, d: ig.fetch_plan(fx.bars(s, d), fx.companies(s, d), "2001-10-20"), f"""WITH {fx.BARS}, {fx.COMPANIES}, h AS (SELECT ticker, max(date) AS high_water FROM bars GROUP BY ticker),
f AS (SELECT ticker, high_water, CASE WHEN high_water IS NULL THEN DATE '2001-10-19' - 729 ELSE high_water + 1 END AS fetch_from, DATE '2001-10-19' AS fetch_to FROM companies LEFT JOIN h USING (ticker))
SELECT *, CASE WHEN fetch_from > fetch_to THEN 'UP_TO_DATE' WHEN high_water IS NULL THEN 'FIRST_LOAD' ELSE 'FETCH' END AS outcome FROM f""")
register("s_outcomes", lambda s, d: ig.outcomes(_target(s, d), ig.upsert(_target(s, d), _update(s, d), ["ticker", "date"])).select("ticker", "before_rows", "after_rows", "new_rows", "outcome"), f"""{_UP},
g AS (SELECT ticker, count(*) FILTER (part IN (0, 1)) AS before_rows, count(*) AS after_rows, max(date) FILTER (part IN (0, 1)) AS b, max(date) AS a FROM v GROUP BY ticker)
SELECT ticker, before_rows, after_rows, after_rows - before_rows AS new_rows, CASE WHEN a > b OR before_rows = 0 THEN 'UPDATED' WHEN after_rows > before_rows THEN 'REFRESHED' ELSE 'NO_NEW_DATA' END AS outcome FROM g""")
register("s_load_audit", lambda s, d: ig.load_audit(fx.table(s, d, "lineitem").withColumn("day", F.to_date("l_shipdate")), ["l_orderkey", "l_linenumber"], "day"), """
SELECT CAST(sum(n) AS BIGINT) AS n_rows, min(lo) AS first, max(hi) AS last, count(*) AS n_keys, count(*) FILTER (n > 1) AS duplicate_keys, CAST(0 AS BIGINT) AS null_l_orderkey, CAST(0 AS BIGINT) AS null_l_linenumber
FROM (SELECT l_orderkey, l_linenumber, count(*) AS n, min(CAST(l_shipdate AS DATE)) AS lo, max(CAST(l_shipdate AS DATE)) AS hi FROM lineitem GROUP BY ALL)""")


def payload_bars(s: SparkSession, d: str) -> DataFrame:
    b = fx.bars(s, d)
    p = b.select("ticker", F.when(F.dayofmonth("date") != 7, F.unix_millis(F.col("date").cast("timestamp"))).alias("t"), *[F.col(n).alias(k) for k, n in tb.BAR_NAMES.items()])
    return tb.flatten_bars(p).select("ticker", "date", F.round("volume", 2).alias("volume"), "transactions")


register("s_flatten_bars", payload_bars, f"WITH {fx.BARS} SELECT ticker, date, round(volume, 2) AS volume, transactions FROM bars WHERE day(date) <> 7")


def typed_events(s: SparkSession, d: str) -> DataFrame:
    e = fx.table(s, d, "events")
    text = e.select(F.col("event_id").cast("string").alias("event_id"), F.when(F.col("event_id") % 10 == 0, "broken").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("ts"), F.col("user_id").cast("string").alias("user_id"), "event_type")
    return tb.typed(text, {"event_id": "bigint", "ts": "timestamp", "user_id": "int", "event_type": "string"}).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


register("s_typed_read", typed_events, "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS ts, CAST(user_id AS INTEGER) AS user_id, event_type FROM events")


def payload_news(s: SparkSession, d: str) -> DataFrame:
    n = fx.news(s, d)
    p = n.select(F.when(F.col("n") % 31 != 0, F.col("article_id")).alias("id"), "requested_ticker", "title", F.struct(F.col("publisher_name").alias("name"), F.concat(F.lit("https://"), "publisher_name").alias("homepage_url")).alias("publisher"), F.date_format("published_utc", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_utc"), "tickers")
    return tb.flatten_news(p).select("article_id", "requested_ticker", "title", "publisher_name", "publisher_homepage_url", F.date_format("published_utc", "yyyy-MM-dd HH:mm:ss").alias("published_utc"), "tickers_json")


register("s_flatten_news", payload_news, f"""WITH {fx.NEWS} SELECT article_id, requested_ticker, title, publisher_name, 'https://' || publisher_name AS publisher_homepage_url, strftime(published_utc, '%Y-%m-%d %H:%M:%S') AS published_utc,
  '[' || coalesce(array_to_string(list_transform(tickers, lambda t: '"' || t || '"'), ','), '') || ']' AS tickers_json FROM news WHERE n % 31 <> 0""")


def payload_companies(s: SparkSession, d: str) -> DataFrame:
    """Supplier rows as nested payloads; every fourth has no branding."""
    x = fx.table(s, d, "supplier")
    i = F.col("s_suppkey")
    p = x.select(F.concat(F.lit(" S"), i.cast("string")).alias("ticker"), F.col("s_name").alias("name"), F.col("s_acctbal").cast("string").alias("market_cap"), (i % 2 == 0).alias("active"), F.struct(F.lit("Main Street").alias("address1"), F.concat(F.lit("City "), F.col("s_nationkey").cast("string")).alias("city")).alias("address"),
                 F.when(i % 4 != 0, F.struct(F.concat(F.lit("https://logo/"), i.cast("string")).alias("logo_url"))).alias("branding"))
    return tb.flatten_company(p).select("ticker", "name", "market_cap", "active", "address1", "city", "state", "logo_url", "icon_url")


register("s_flatten_company", payload_companies, """SELECT 'S' || s_suppkey AS ticker, s_name AS name, CAST(s_acctbal AS DOUBLE) AS market_cap, s_suppkey % 2 = 0 AS active, 'Main Street' AS address1, 'City ' || s_nationkey AS city,
  CAST(NULL AS VARCHAR) AS state, CASE WHEN s_suppkey % 4 <> 0 THEN 'https://logo/' || s_suppkey END AS logo_url, CAST(NULL AS VARCHAR) AS icon_url FROM supplier""")
register("s_layout", lambda s, d: tb.layout(fx.table(s, d, "lineitem")))


def _plan(s: SparkSession, d: str) -> DataFrame:
    return iv.backfill_plan(events(s, d).where("is_anomaly"), nw.relations(fx.news(s, d), fx.companies(s, d)))


_PLAN = f"""WITH {METRICS}, {ANOMALIES}, {fx.COMPANIES}, {fx.NEWS}, {REL},
have AS (SELECT ticker, min(published_date) AS a, max(published_date) AS z FROM rel GROUP BY ticker),
want AS (SELECT ticker, date AS event_date, date - 3 AS s, date + 3 AS e, a, z FROM anomalies LEFT JOIN have USING (ticker) WHERE is_anomaly),
rest AS (
  SELECT ticker, event_date, s, e FROM want WHERE a IS NULL OR e < a OR s > z
  UNION ALL SELECT ticker, event_date, s, a - 1 FROM want WHERE NOT (e < a OR s > z) AND s < a
  UNION ALL SELECT ticker, event_date, z + 1, e FROM want WHERE NOT (e < a OR s > z) AND e > z),
g1 AS (SELECT *, max(e) OVER (PARTITION BY ticker ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM rest),
g2 AS (SELECT *, sum(CASE WHEN seen IS NULL OR s > seen + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM g1),
plan AS (SELECT ticker, min(s) AS start_date, max(e) AS end_date, count(DISTINCT event_date) AS events, max(e) - min(s) + 1 AS days FROM g2 GROUP BY ticker, island)"""
register("v_backfill_plan", _plan, f"{_PLAN} SELECT * FROM plan")
register("v_plan_totals", lambda s, d: iv.plan_totals(_plan(s, d)), f"{_PLAN} SELECT ticker, count(*) AS intervals, CAST(sum(days) AS BIGINT) AS days, CAST(sum(events) AS BIGINT) AS events, min(start_date) AS first_day, max(end_date) AS last_day FROM plan GROUP BY ticker")


def open_days(s: SparkSession, d: str) -> DataFrame:
    """Bars by month, those on open days, and holidays met."""
    c = cal.trading_calendar(s, "1992-01-01", "2003-12-31")
    return fx.bars(s, d).join(F.broadcast(c), "date").groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("bars"), F.count_if("is_open").alias("open_bars"), F.array_join(F.array_sort(F.collect_set("holiday")), ",").alias("holidays"))


_CAL = """
day0 AS (SELECT CAST(unnest(generate_series(DATE '1992-01-01', DATE '2003-12-31', INTERVAL 1 DAY)) AS DATE) AS date),
east AS (SELECT y, make_date(y, 3, 21) + CAST(moon - CASE WHEN moon = 29 OR (moon = 28 AND g > 10) THEN 1 ELSE 0 END AS INTEGER) AS full_moon
  FROM (SELECT y, y % 19 AS g, (19 * (y % 19) + y // 100 - (y // 100) // 4 - (8 * (y // 100) + 13) // 25 + 15) % 30 AS moon FROM (SELECT CAST(unnest(range(1992, 2004)) AS INTEGER) AS y))),
day1 AS (SELECT date, full_moon + 7 - CAST(dayofweek(full_moon) AS INTEGER) AS easter, dayofweek(date) AS w, month(date) AS m, day(date) AS dd FROM day0 JOIN east ON year(date) = y),
day2 AS (SELECT date, w, CASE
    WHEN (m = 1 AND dd = 1 AND w BETWEEN 1 AND 5) OR (w = 5 AND month(date + 1) = 1 AND day(date + 1) = 1) OR (w = 1 AND month(date - 1) = 1 AND day(date - 1) = 1) THEN 'New Year''s Day'
    WHEN m = 1 AND w = 1 AND ceil(dd / 7.0) = 3 THEN 'Martin Luther King Jr. Day' WHEN m = 2 AND w = 1 AND ceil(dd / 7.0) = 3 THEN 'Washington''s Birthday' WHEN date = easter - 2 THEN 'Good Friday'
    WHEN m = 5 AND w = 1 AND month(date + 7) <> 5 THEN 'Memorial Day'
    WHEN (m = 7 AND dd = 4 AND w BETWEEN 1 AND 5) OR (w = 5 AND m = 7 AND dd = 3) OR (w = 1 AND m = 7 AND dd = 5) THEN 'Independence Day'
    WHEN m = 9 AND w = 1 AND dd <= 7 THEN 'Labor Day' WHEN m = 11 AND w = 4 AND ceil(dd / 7.0) = 4 THEN 'Thanksgiving'
    WHEN (m = 12 AND dd = 25 AND w BETWEEN 1 AND 5) OR (w = 5 AND m = 12 AND dd = 24) OR (w = 1 AND m = 12 AND dd = 26) THEN 'Christmas' END AS holiday FROM day1)"""
register("v_open_days", open_days, f"WITH {fx.BARS}, {_CAL} SELECT strftime(date, '%Y-%m') AS month, count(*) AS bars, count(*) FILTER (w BETWEEN 1 AND 5 AND holiday IS NULL) AS open_bars, coalesce(string_agg(DISTINCT holiday, ',' ORDER BY holiday), '') AS holidays FROM bars JOIN day2 USING (date) GROUP BY 1")


def _fresh(s: SparkSession, d: str) -> DataFrame:
    n = nw.relations(fx.news(s, d), fx.companies(s, d)).select("ticker", F.col("published_utc").alias("loaded_at"))
    return cal.freshness(fx.bars(s, d).select("ticker", "date"), n, fx.companies(s, d).select("ticker"), cal.trading_calendar(s, "2001-01-01", "2001-12-31"), "2001-10-20 12:00:00")


_FRESH = f"""WITH {fx.BARS}, {fx.COMPANIES}, {fx.NEWS}, {REL},
p AS (SELECT 'prices' AS data_type, ticker, CASE WHEN seen_at IS NULL THEN 'ERROR' WHEN seen_at >= DATE '2001-10-19' THEN 'FRESH' ELSE 'STALE' END AS status, CAST(seen_at AS VARCHAR) AS last_value, greatest(DATE '2001-10-19' - seen_at, 0) AS lag_days
  FROM companies LEFT JOIN (SELECT ticker, max(date) AS seen_at FROM bars GROUP BY ticker) USING (ticker)),
n AS (SELECT 'news' AS data_type, ticker, CASE WHEN seen_at IS NULL THEN 'ERROR' WHEN date_diff('second', seen_at, TIMESTAMP '2001-10-20 12:00:00') <= 30 * 3600 THEN 'FRESH' ELSE 'STALE' END AS status, strftime(seen_at, '%Y-%m-%d %H:%M:%S') AS last_value, greatest(DATE '2001-10-20' - CAST(seen_at AS DATE), 0) AS lag_days
  FROM companies LEFT JOIN (SELECT ticker, max(published_utc) AS seen_at FROM rel GROUP BY ticker) USING (ticker)),
u AS (SELECT * FROM p UNION ALL SELECT * FROM n),
fresh AS (SELECT * FROM u UNION ALL SELECT 'system', 'ALL', CASE WHEN count(*) FILTER (status = 'ERROR') > 0 THEN 'ERROR' WHEN count(*) FILTER (status = 'STALE') > 0 THEN 'STALE' ELSE 'FRESH' END,
  'fresh=' || count(*) FILTER (status = 'FRESH') || ' stale=' || count(*) FILTER (status = 'STALE') || ' error=' || count(*) FILTER (status = 'ERROR'), max(lag_days) FROM u)"""
register("v_freshness", _fresh, f"{_FRESH} SELECT * FROM fresh")
register("v_freshness_report", lambda s, d: cal.freshness_report(_fresh(s, d)), f"{_FRESH} SELECT data_type, CASE data_type WHEN 'system' THEN 0 WHEN 'prices' THEN 1 ELSE 2 END AS place, count(*) FILTER (status = 'FRESH') AS fresh, count(*) FILTER (status = 'STALE') AS stale, count(*) FILTER (status = 'ERROR') AS error, max(lag_days) AS max_lag_days FROM fresh GROUP BY data_type")
