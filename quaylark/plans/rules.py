"""Queries of loads, normalisation by rule tables, roll-ups of several levels, and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylark.operators import clean as cl
from quaylark.operators import impact as im
from quaylark.operators import ingest as ig
from quaylark.operators import news as nw
from quaylark.operators import quality as qa
from quaylark.operators import serving as sv
from quaylark.plans.catalog import register
from quaylark.plans.market import ANOMALIES, METRICS, events, r
from quaylark.plans.newsroom import _BASE, _EV, _RK, SUMMARY, _links, _rel, _summary, ranked
from quaylark.sources import fixtures as fx
from quaylark.sources import tables as tb
from quaylark.sources.shared import new_folder, stored


def payload(s: SparkSession, d: str) -> DataFrame:
    """News as a provider sends it: padded text, nested publisher, lists that may be missing;
    every 31st without id."""
    n = fx.news(s, d)
    i = F.col("n")
    text = lambda c: F.concat(F.lit("  "), c, F.lit(" "))
    url = lambda what: F.when(i % 4 != 0, text(F.concat(F.lit(f"https://{what}/"), i.cast("string"))))
    return n.select(
        F.when(i % 31 != 0, F.col("article_id")).alias("id"), F.lower(text(F.col("requested_ticker"))).alias("requested_ticker"), text(F.col("title")).alias("title"),
        F.when(i % 3 != 0, text(F.concat(F.lit("Author "), (i % 7).cast("string")))).alias("author"), text(F.substring("description", 1, 40)).alias("description"),
        url("article").alias("article_url"), url("amp").alias("amp_url"), url("image").alias("image_url"),
        F.when(i % 6 != 0, F.struct(text(F.col("publisher_name")).alias("name"), url("home").alias("homepage_url"), url("logo").alias("logo_url"), url("icon").alias("favicon_url"))).alias("publisher"),
        F.date_format("published_utc", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_utc"),
        "tickers", F.when(i % 8 != 0, F.array(F.concat(F.lit(" k"), (i % 5).cast("string"), F.lit(" ")), F.lit("all"))).alias("keywords"), "insights", "n")


_PAYLOAD = f"""WITH {fx.NEWS}, url AS (SELECT *, CASE WHEN n % 4 <> 0 THEN n END AS u, CASE WHEN n % 6 <> 0 AND n % 4 <> 0 THEN n END AS pu FROM news WHERE n % 31 <> 0),
flat AS (
  SELECT article_id, lower('  ' || requested_ticker || ' ') AS requested_ticker, '  ' || title || ' ' AS title, CASE WHEN n % 3 <> 0 THEN '  Author ' || (n % 7) || ' ' END AS author,
    '  ' || substr(description, 1, 40) || ' ' AS description, '  https://article/' || u || ' ' AS article_url, '  https://amp/' || u || ' ' AS amp_url, '  https://image/' || u || ' ' AS image_url,
    strftime(published_utc, '%Y-%m-%d %H:%M:%S') AS published_utc, CASE WHEN n % 6 <> 0 THEN '  ' || publisher_name || ' ' END AS publisher_name, '  https://home/' || pu || ' ' AS publisher_homepage_url,
    '  https://logo/' || pu || ' ' AS publisher_logo_url, '  https://icon/' || pu || ' ' AS publisher_favicon_url,
    '[' || coalesce(array_to_string(list_transform(tickers, lambda t: '"' || t || '"'), ','), '') || ']' AS tickers_json,
    CASE WHEN n % 8 <> 0 THEN '[" k' || (n % 5) || ' ","all"]' ELSE '[]' END AS keywords_json, n, tickers, insights, sentiment FROM url)"""
_FLAT = [c for c in tb.NEWS if c not in ("insights_json", "_ingested_at", "_source")]


def flat_news(s: SparkSession, d: str) -> DataFrame:
    return tb.flatten_news(payload(s, d)).withColumn("published_utc", F.date_format("published_utc", "yyyy-MM-dd HH:mm:ss")).select(*_FLAT, F.size(F.from_json("insights_json", nw.INSIGHTS)).alias("n_insights"))


register("s_flatten_news_fields", flat_news, f"{_PAYLOAD} SELECT {', '.join(_FLAT)}, CAST(coalesce(len(insights), 0) AS INTEGER) AS n_insights FROM flat")


def loaded_news(s: SparkSession, d: str) -> DataFrame:
    """Flattened news as text columns, as loads store them: every ninth with broken keywords, every
    29th with broken tickers, every 23rd without title, every 37th with a broken time."""
    df = tb.flatten_news(payload(s, d)).withColumns({c: F.col(c).cast("string") for c in ("published_utc",)})
    i = F.col("article_id").cast("long")
    df = df.withColumns({"keywords_json": F.when(i % 9 == 0, "{bad").otherwise(F.col("keywords_json")), "tickers_json": F.when(i % 29 == 0, "[1,").otherwise(F.col("tickers_json")), "title": F.when(i % 23 != 0, F.col("title")), "published_utc": F.when(i % 37 == 0, "soon").otherwise(F.col("published_utc"))})
    return tb.typed(df.withColumns({"_ingested_at": F.lit("2001-12-01T00:00:00Z"), "_source": F.lit("feed")}), tb.NEWS)


_LOADED = f"""{_PAYLOAD}, loaded AS (SELECT * REPLACE (
  CASE WHEN n % 9 = 0 THEN '{{bad' ELSE keywords_json END AS keywords_json, CASE WHEN n % 29 = 0 THEN '[1,' ELSE tickers_json END AS tickers_json, CASE WHEN n % 23 <> 0 THEN title END AS title,
  CASE WHEN n % 37 <> 0 THEN published_utc END AS published_utc) FROM flat)"""
_TEXT = ("title", "author", "description", "article_url", "amp_url", "image_url", "publisher_name", "publisher_homepage_url")


def read_news(s: SparkSession, d: str) -> DataFrame:
    df = loaded_news(s, d)
    return df.select(*[c for c in _FLAT if c != "published_utc"], F.date_format("published_utc", "yyyy-MM-dd HH:mm:ss").alias("published_utc"), F.date_format("_ingested_at", "yyyy-MM-dd").alias("loaded"), "_source")


register("s_read_news", read_news, f"{_LOADED} SELECT {', '.join(_FLAT)}, '2001-12-01' AS loaded, 'feed' AS _source FROM loaded")


def news_columns(s: SparkSession, d: str) -> DataFrame:
    df = nw.clean_news(loaded_news(s, d))
    return df.select("article_id", "requested_ticker", *_TEXT, F.array_join("keywords", ",").alias("keywords"), F.array_join("tickers", ",").alias("tickers"), F.size("insights").alias("n_insights"), "bad_tickers", "bad_keywords", "bad_insights", "valid")


register("c_news_columns", news_columns, f"""{_LOADED} SELECT article_id, upper(trim(requested_ticker, ' ')) AS requested_ticker, {', '.join(f"trim({c}, ' ') AS {c}" for c in _TEXT)},
  CASE WHEN n % 9 <> 0 THEN CASE WHEN n % 8 <> 0 THEN 'k' || (n % 5) || ',all' ELSE '' END END AS keywords, CASE WHEN n % 29 <> 0 THEN coalesce(upper(array_to_string(tickers, ',')), '') END AS tickers, CAST(coalesce(len(insights), 0) AS INTEGER) AS n_insights,
  n % 29 = 0 AS bad_tickers, n % 9 = 0 AS bad_keywords, false AS bad_insights, coalesce(trim(title, ' ') <> '', false) AND published_utc IS NOT NULL AS valid FROM loaded""")
register("c_news_parse_failures", lambda s, d: nw.parse_failures(nw.clean_news(loaded_news(s, d))), f"{_LOADED} SELECT count(*) AS n_rows, count(*) FILTER (n % 29 = 0) AS bad_tickers, count(*) FILTER (n % 9 = 0) AS bad_keywords, CAST(0 AS BIGINT) AS bad_insights FROM loaded WHERE trim(title, ' ') <> '' AND published_utc IS NOT NULL")
register("s_null_audit", lambda s, d: ig.null_audit(loaded_news(s, d).select(*_FLAT)), f"{_LOADED} " + " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) FILTER ({c} IS NULL) AS nulls, count(*) AS n_rows FROM loaded" for c in _FLAT))
register("s_newest", lambda s, d: ig.newest(loaded_news(s, d), "published_utc", ["article_id"]).select("place", "article_id", "requested_ticker", "publisher_name", "title"), f"{_LOADED} SELECT row_number() OVER (ORDER BY published_utc DESC NULLS LAST, article_id) AS place, article_id, requested_ticker, publisher_name, title FROM loaded QUALIFY row_number() OVER (ORDER BY published_utc DESC NULLS LAST, article_id) <= 20")


def company_text(s: SparkSession, d: str) -> DataFrame:
    """Suppliers as loaded companies: all columns as text, padded and in mixed case; some numbers
    negative or no numbers, some names blank, some days broken."""
    x = fx.table(s, d, "supplier")
    i = F.col("s_suppkey")
    text = lambda c: F.concat(F.lit(" "), F.lit(c[:1].upper() + c[1:]), F.lit(" "), (i % 9).cast("string"), F.lit(" "))
    number = lambda k: F.when(i % k == 0, "-5").when(i % k == 1, "many").when(i % k == 2, F.lit(None)).otherwise((i * 1000).cast("string"))
    out = {c: text(c) for cs in cl.COMPANY_TEXT.values() for c in cs} | {c: number(k) for c, k in zip(cl.COMPANY_NUMBERS, (11, 13, 17, 19, 23))}
    out |= {"ticker": F.concat(F.lit(" s"), i.cast("string"), F.lit(" ")), "name": F.when(i % 10 == 0, "  ").otherwise(F.col("s_name")), "state": F.when(i % 5 != 0, " ny "), "active": F.when(i % 2 == 0, "true").otherwise("false")}
    out |= {"list_date": F.when(i % 7 == 0, "unknown").otherwise(F.date_add(F.lit("1990-01-15").cast("date"), (i * 29).cast("int")).cast("string")), "_ingested_at": F.lit("2001-12-01T00:00:00Z"), "_source": F.lit("feed")}
    return x.select(*[v.alias(k) for k, v in out.items()])


def company_rows(s: SparkSession, d: str) -> DataFrame:
    typed = tb.typed(company_text(s, d), tb.COMPANY_LOADED)
    df = cl.judge(cl.normalise_companies(typed), cl.company_rules())
    return cl.company_profile(df, fx.AS_OF).drop("_ingested_at").withColumn("failed", F.array_join("failed", ","))


def _company_sql() -> str:
    case = {"upper": "upper(trim({}, ' '))", "lower": "lower(trim({}, ' '))", "trim": "trim({}, ' ')"}
    own = {"ticker": "' s' || s_suppkey || ' '", "name": "CASE WHEN s_suppkey % 10 = 0 THEN '  ' ELSE s_name END", "state": "CASE WHEN s_suppkey % 5 <> 0 THEN ' ny ' END"}
    text = [f"{case[k].format(own.get(c, f"' {c[:1].upper() + c[1:]} ' || (s_suppkey % 9) || ' '"))} AS {c}" for k, cs in cl.COMPANY_TEXT.items() for c in cs]
    numbers = [f"CAST(CASE s_suppkey % {k} WHEN 0 THEN -5 WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE s_suppkey * 1000 END AS {'DOUBLE' if c == 'market_cap' else 'BIGINT'}) AS {c}" for c, k in zip(cl.COMPANY_NUMBERS, (11, 13, 17, 19, 23))]
    failed = ", ".join(f"CASE WHEN {c} < 0 THEN '{c}' END" for c in cl.COMPANY_NUMBERS)
    return f"""WITH c AS (SELECT {', '.join(text + numbers)}, s_suppkey % 2 = 0 AS active, CASE WHEN s_suppkey % 7 <> 0 THEN DATE '1990-01-15' + CAST(s_suppkey * 29 AS INTEGER) END AS list_date, 'feed' AS _source FROM supplier),
f AS (SELECT *, concat_ws(',', CASE WHEN name = '' THEN 'name' END, {failed}) AS failed FROM c)
SELECT *, failed = '' AS valid, {r('market_cap / 1e9', 4)} AS market_cap_billions, concat_ws(', ', city, state) AS location,
  CAST(floor((date_diff('month', list_date, DATE '{fx.AS_OF}') - CASE WHEN day(list_date) > day(DATE '{fx.AS_OF}') AND NOT (list_date = last_day(list_date) AND DATE '{fx.AS_OF}' = last_day(DATE '{fx.AS_OF}')) THEN 1 ELSE 0 END) / 12.0) AS BIGINT) AS years_listed FROM f"""


register("c_company_rules", company_rows, _company_sql())
register("s_read_companies", lambda s, d: tb.typed(company_text(s, d), tb.COMPANY_LOADED).groupBy("active").agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"known_{c}") for c in tb.COMPANY_LOADED if c != "active"]), "SELECT s_suppkey % 2 = 0 AS active, count(*) AS n, " + ", ".join(
    (f"count(*) FILTER (s_suppkey % {dict(zip(cl.COMPANY_NUMBERS, (11, 13, 17, 19, 23)))[c]} NOT IN (1, 2))" if c in cl.COMPANY_NUMBERS else "count(*) FILTER (s_suppkey % 7 <> 0)" if c == "list_date" else "count(*) FILTER (s_suppkey % 5 <> 0)" if c == "state" else "count(*)") + f" AS known_{c}" for c in tb.COMPANY_LOADED if c != "active") + " FROM supplier GROUP BY 1")


def loaded_twice(s: SparkSession, d: str) -> DataFrame:
    """Bars loaded at several times, with other closes; some loads have no time."""
    b = fx.bars(s, d).select("ticker", "date", "close")
    k = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    return b.withColumn("load", k).where((F.dayofmonth("date") + F.col("load")) % 3 != 0).withColumns({"close": F.col("close") + F.col("load"), "_ingested_at": F.when((F.dayofmonth("date") + F.col("load")) % 4 != 0, F.timestamp_seconds(1_000_000_000 - F.col("load") * 60))}).drop("load")


register("c_latest_prices", lambda s, d: cl.latest_versions(loaded_twice(s, d), ["ticker", "date"]).select("ticker", "date", F.round(F.round("close", 9), 4).alias("close")), f"""WITH {fx.BARS},
v AS (SELECT ticker, date, close + k AS close, CASE WHEN (day(date) + k) % 4 <> 0 THEN -k END AS loaded_at FROM bars CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) WHERE (day(date) + k) % 3 <> 0)
SELECT ticker, date, {r('close', 4)} AS close FROM v QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY loaded_at DESC NULLS LAST, close DESC) = 1""")
register("q_news_history", lambda s, d: sv.last_n(nw.news_daily(_rel(s, d)), 30, ts="published_date").select("ticker", "published_date", "place", "articles", "dominant"), f"""{_BASE}, g AS (SELECT ticker, published_date, count(DISTINCT article_id) AS articles, count(*) FILTER (sentiment = 'positive') AS p, count(*) FILTER (sentiment = 'negative') AS n, count(*) FILTER (sentiment = 'neutral') AS u FROM rel GROUP BY ALL)
SELECT ticker, published_date, row_number() OVER (PARTITION BY ticker ORDER BY published_date DESC) AS place, articles,
  CASE WHEN p + n + u = 0 THEN 'NO_DATA' WHEN p > n AND p > u THEN 'POSITIVE' WHEN n > p AND n > u THEN 'NEGATIVE' WHEN u > p AND u > n THEN 'NEUTRAL' ELSE 'MIXED' END AS dominant
FROM g QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY published_date DESC) <= 30""")


def managed(s: SparkSession, d: str) -> DataFrame:
    """A partitioned table: made, loaded, made again, one year rewritten with one column more."""
    path = new_folder(s, "managed")
    name = "t" + path.rsplit("-", 1)[1]
    b = fx.bars(s, d).select("ticker", "date", F.round("volume", 2).alias("volume"), F.year("date").alias("year"))
    ddl = "ticker STRING, date DATE, volume DOUBLE, year INT"
    tb.ensure_table(s, name, ddl, partition_by=["year"], path=path)
    try:
        tb.overwrite_partitions(b, name)
        tb.ensure_table(s, name, ddl, partition_by=["year"], path=path)
        tb.overwrite_partitions(b.where("year = 1996 and dayofmonth(date) < 20").withColumn("note", F.lit("rewritten")), name)
    finally:
        s.sql(f"DROP TABLE IF EXISTS {name}")  # the files stay
    got = s.read.option("mergeSchema", "true").parquet(path)
    return got.groupBy("year", "note").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("volume"), 2).alias("volume"))


register("s_managed_table", managed, f"WITH {fx.BARS} SELECT year(date) AS year, CASE WHEN year(date) = 1996 THEN 'rewritten' END AS note, count(*) AS n, round(sum(round(volume, 2)), 2) AS volume FROM bars WHERE year(date) <> 1996 OR day(date) < 20 GROUP BY ALL")

register("n_coverage_levels", lambda s, d: nw.coverage_levels(_rel(s, d), events(s, d).where("is_anomaly")), f"""WITH {METRICS}, {ANOMALIES}, {fx.COMPANIES}, {fx.NEWS}, {_BASE.partition(fx.NEWS + ',')[2]},
b AS (SELECT ticker, published_date AS day, true AS is_news FROM rel UNION ALL SELECT ticker, date, false FROM anomalies WHERE is_anomaly), m AS (SELECT *, strftime(day, '%Y-%m') AS month FROM b)
SELECT CASE grouping(ticker, month) WHEN 1 THEN 'TICKER' WHEN 2 THEN 'MONTH' ELSE 'ALL' END AS level, ticker, month, count(*) FILTER (is_news) AS news_rows, min(day) FILTER (is_news) AS news_first, max(day) FILTER (is_news) AS news_last,
  count(*) FILTER (NOT is_news) AS events_rows, min(day) FILTER (NOT is_news) AS events_first, max(day) FILTER (NOT is_news) AS events_last FROM m GROUP BY GROUPING SETS ((ticker), (month), ())""")
_SPREAD = ", ".join(f"min({c}) AS min_{c}, {r(f'avg({c})', 4)} AS avg_{c}, max({c}) AS max_{c}" for c in ("n", "context", "direct", "title"))
_PER = """per AS (SELECT ticker, event_id, count(*) AS n, count(*) FILTER (context_rank <= 5) AS context, count(*) FILTER (match_level <> 'NONE') AS direct, count(*) FILTER (title_match) AS title, min(relevance_score) AS worst, max(relevance_score) AS best, sum(relevance_score) AS total
  FROM ranked WHERE news_rank <= 10 OR context_rank <= 5 GROUP BY ALL)"""
register("r_quality_levels", lambda s, d: im.ranking_levels(im.top_news(ranked(s, d))), f"""{_RK}, {_PER}
SELECT CASE WHEN grouping(ticker) = 0 THEN 'TICKER' ELSE 'ALL' END AS level, ticker, count(*) AS events, {_SPREAD}, {r('100.0 * sum(direct) / sum(n)', 4)} AS direct_pct, {r('100.0 * sum(title) / sum(n)', 4)} AS title_pct, min(worst) AS min_score, {r('sum(total) / sum(n)', 4)} AS avg_score, max(best) AS max_score
FROM per GROUP BY GROUPING SETS ((ticker), ())""")

_TOTALS = {"news: relations add up": ("news", ["pre", "same", "post"]), "news: sentiments add up": ("news", ["positive", "negative", "neutral", "mixed", "unknown"])}


def totals(s: SparkSession, d: str) -> DataFrame:
    """Event summaries, of which those of a 13th lost a post-event article and those of a 7th have a
    sentiment too many."""
    df = _summary(s, d).withColumns({"post": F.when(F.dayofmonth("event_date") == 13, F.col("post") - 1).otherwise(F.col("post")), "mixed": F.when(F.dayofmonth("event_date") == 7, F.col("mixed") + 1).otherwise(F.col("mixed"))})
    return qa.verdict(s, [qa.parts_add_up(df, _TOTALS)])


register("d_totals", totals, f"""{_EV}, {SUMMARY}, broken AS (SELECT * REPLACE (CASE WHEN day(event_date) = 13 THEN post - 1 ELSE post END AS post, CASE WHEN day(event_date) = 7 THEN mixed + 1 ELSE mixed END AS mixed) FROM summary),
v AS ({' UNION ALL '.join(f"SELECT '{n}' AS rule, count(*) FILTER ({' + '.join(parts)} <> {total}) AS violations FROM broken" for n, (total, parts) in _TOTALS.items())})
SELECT rule, violations, violations = 0 AS passed FROM v UNION ALL SELECT 'ALL', count(*) FILTER (violations > 0), count(*) FILTER (violations > 0) = 0 FROM v""")

# Limits, in percent but for the numbers of top news of an event.
LIMITS = (("anomaly rate", 0.0, 10.0), ("events with news", 100.0, 100.0), ("direct matches", 90.0, None), ("title matches", 75.0, None), ("first rank direct", 95.0, None), ("least top news", 10.0, 15.0), ("most top news", 10.0, 15.0))


def thresholds(s: SparkSession, d: str) -> DataFrame:
    rk = stored(ranked(s, d).select("event_id", "match_level", "title_match", "news_rank", "context_rank"))
    top = im.top_news(rk)
    n = F.count(F.lit(1))
    pct = lambda hit, of=n: 100.0 * F.count_if(hit) / F.when(of > 0, of)
    direct = F.col("match_level") != "NONE"
    measured = {
        "anomaly rate": events(s, d).agg(pct(F.col("is_anomaly")).alias("value")), "events with news": _summary(s, d).agg(pct(F.col("has_news")).alias("value")),
        "first rank direct": rk.where("news_rank = 1").agg(pct(direct).alias("value")),
    }
    per = top.groupBy("event_id").agg(n.alias("n"), F.count_if(direct).alias("direct"), F.count_if("title_match").alias("title"))
    pairs = per.agg(F.min("n").alias("least top news"), F.max("n").alias("most top news"), (100.0 * F.sum("direct") / F.sum("n")).alias("direct matches"), (100.0 * F.sum("title") / F.sum("n")).alias("title matches"))
    rows = pairs.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(f"`{c}`").cast("double").alias("value")) for c in pairs.columns])).alias("x")).select("x.*")
    for name, df in measured.items():
        rows = rows.unionByName(df.select(F.lit(name).alias("rule"), "value"))
    return qa.within(rows, s.createDataFrame(list(LIMITS), "rule string, low double, high double"))


_SQL = lambda x: "CAST(NULL AS DOUBLE)" if x is None else f"CAST({x} AS DOUBLE)"
register("d_thresholds", thresholds, f"""{_RK}, {SUMMARY}, {_PER},
lim AS ({' UNION ALL '.join(f"SELECT '{n}' AS rule, {_SQL(lo)} AS low, {_SQL(hi)} AS high" for n, lo, hi in LIMITS)}),
val AS (SELECT 'anomaly rate' AS rule, 100.0 * count(*) FILTER (is_anomaly) / count(*) AS value FROM anomalies UNION ALL SELECT 'events with news', 100.0 * count(*) FILTER (has_news) / count(*) FROM summary
  UNION ALL SELECT 'first rank direct', 100.0 * count(*) FILTER (match_level <> 'NONE') / count(*) FROM ranked WHERE news_rank = 1
  UNION ALL SELECT 'least top news', min(n) FROM per UNION ALL SELECT 'most top news', max(n) FROM per UNION ALL SELECT 'direct matches', 100.0 * sum(direct) / sum(n) FROM per UNION ALL SELECT 'title matches', 100.0 * sum(title) / sum(n) FROM per)
SELECT rule, {r('value', 4)} AS value, low, high, coalesce((low IS NULL OR value >= low) AND (high IS NULL OR value <= high) AND value IS NOT NULL, false) AS passed FROM lim LEFT JOIN val USING (rule)""")
