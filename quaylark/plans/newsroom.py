"""Queries over news and its relation to events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylark.operators import impact as im
from quaylark.operators import news as nw
from quaylark.plans.catalog import register
from quaylark.plans.market import ANOMALIES, METRICS, events, r
from quaylark.sources import fixtures as fx


def _rel(s: SparkSession, d: str) -> DataFrame:
    return nw.relations(fx.news(s, d), fx.companies(s, d))


def clean(s: SparkSession, d: str) -> DataFrame:
    df = nw.clean_news(fx.news(s, d))
    return df.select("article_id", "requested_ticker", "title", F.array_join("tickers", ",").alias("tickers"), F.size("insights").alias("n_insights"), "bad_tickers", "bad_insights", "own_sentiment", "own_reasoning", "published_date", "valid")


CLEAN_SQL = f"""WITH {fx.NEWS}, c AS (SELECT *, n % 29 = 0 AS bad FROM news)
SELECT article_id, upper(requested_ticker) AS requested_ticker, trim(title, ' ') AS title, CASE WHEN NOT bad THEN upper(array_to_string(tickers, ',')) END AS tickers,
  CASE WHEN NOT bad THEN len(insights) END AS n_insights, bad AS bad_tickers, bad AS bad_insights,
  CASE WHEN NOT bad AND list_contains(tickers, requested_ticker) AND insights IS NOT NULL THEN lower(sentiment) END AS own_sentiment,
  CASE WHEN NOT bad AND list_contains(tickers, requested_ticker) AND insights IS NOT NULL THEN trim(title, ' ') END AS own_reasoning,
  CAST(published_utc AS DATE) AS published_date, trim(title, ' ') <> '' AS valid FROM c"""
register("c_clean_news", clean, CLEAN_SQL)
register("c_duplicate_profile", lambda s, d: nw.duplicate_profile(fx.table(s, d, "lineitem").select(F.col("l_partkey").alias("article_id"), F.col("l_suppkey").alias("requested_ticker"))).select("n_rows", "n_ids", "n_keys", "repeated_keys", (-F.get("most", F.lit(0))["less"]).alias("highest")),
         """WITH p AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(DISTINCT l_partkey) AS n_ids, count(*) AS n_keys, count(*) FILTER (n > 1) AS repeated_keys, CASE WHEN max(n) > 1 THEN max(n) END AS highest FROM p""")
register("c_parse_failures", lambda s, d: nw.clean_news(fx.news(s, d)).where("valid").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("bad_tickers").alias("bad_tickers"), F.count_if("bad_insights").alias("bad_insights"), F.count_distinct("article_id").alias("n_articles"), F.count_distinct("article_id", "requested_ticker").alias("n_pairs")),
         f"WITH {fx.NEWS} SELECT count(*) AS n_rows, count(*) FILTER (n % 29 = 0) AS bad_tickers, count(*) FILTER (n % 29 = 0) AS bad_insights, count(DISTINCT article_id) AS n_articles, count(DISTINCT (article_id, requested_ticker)) AS n_pairs FROM news WHERE trim(title, ' ') <> ''")

REL = """
told AS (SELECT article_id, publisher_name, title, published_utc, i.ticker AS ticker, i.sentiment AS sentiment, 1 AS priority FROM (SELECT *, unnest(insights) AS i FROM news)),
rel AS (
  SELECT * REPLACE (CASE WHEN sentiment IN ('positive', 'negative', 'neutral') THEN sentiment END AS sentiment), CAST(published_utc AS DATE) AS published_date
  FROM (SELECT * FROM told UNION ALL SELECT article_id, publisher_name, title, published_utc, requested_ticker, NULL, 0 FROM news)
  WHERE ticker IN (SELECT ticker FROM companies)
  QUALIFY row_number() OVER (PARTITION BY article_id, ticker ORDER BY priority DESC, published_utc DESC, sentiment NULLS LAST) = 1)"""


def _ratio_sql(p: str = "") -> str:
    s = f"({p}positive + {p}negative + {p}neutral)"
    x = lambda a, b: r(f"CASE WHEN {b} <> 0 THEN ({a}) * 100.0 / {b} END", 4)
    g = f"greatest({p}positive, {p}negative, {p}neutral)"
    alone = f"(CAST({p}positive = {g} AS INT) + CAST({p}negative = {g} AS INT) + CAST({p}neutral = {g} AS INT) = 1)"
    return f"""{x(f'{p}positive - {p}negative', s)} AS {p}score, {x(s, f'{p}articles')} AS {p}coverage_pct, {x(f'{p}positive', s)} AS {p}positive_pct, {x(f'{p}negative', s)} AS {p}negative_pct, {x(f'{p}neutral', s)} AS {p}neutral_pct,
    CASE WHEN {s} = 0 THEN 'NO_DATA' WHEN {alone} AND {p}positive = {g} THEN 'POSITIVE' WHEN {alone} AND {p}negative = {g} THEN 'NEGATIVE' WHEN {alone} AND {p}neutral = {g} THEN 'NEUTRAL' ELSE 'MIXED' END AS {p}dominant"""


_BASE = f"WITH {fx.BARS}, {fx.COMPANIES}, {fx.NEWS}, {REL}"
DAILY = f"""g AS (
  SELECT ticker, published_date, count(DISTINCT article_id) AS articles, count(DISTINCT publisher_name) AS publishers, count(*) FILTER (sentiment = 'positive') AS positive,
    count(*) FILTER (sentiment = 'negative') AS negative, count(*) FILTER (sentiment = 'neutral') AS neutral FROM rel GROUP BY ALL)
SELECT *, {_ratio_sql()} FROM g"""
register("n_daily", lambda s, d: nw.news_daily(_rel(s, d)).drop("latest_utc"), f"{_BASE}, {DAILY}")


def _win(n: int) -> str:
    w = f"published_date >= as_of - {n - 1}"
    return f"""count(DISTINCT article_id) FILTER ({w}) AS d{n}_articles, count(DISTINCT publisher_name) FILTER ({w}) AS d{n}_publishers, """ + ", ".join(f"count(*) FILTER ({w} AND sentiment = '{x}') AS d{n}_{x}" for x in nw.SENTIMENTS)


_ZERO = ["articles"] + [f"d{n}_{c}" for n in (7, 30) for c in ("articles", "publishers", *nw.SENTIMENTS)]
NEWS_SUMMARY = f"""clock AS (SELECT max(published_date) AS as_of FROM rel),
g AS (SELECT ticker, count(DISTINCT article_id) AS articles, {_win(7)}, {_win(30)} FROM rel CROSS JOIN clock GROUP BY ticker),
last AS (SELECT ticker, article_id AS latest_article, title AS latest_title, published_date AS latest_date FROM rel QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY published_utc DESC, article_id) = 1),
z AS (SELECT companies.ticker, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _ZERO)}, latest_article, latest_title, latest_date, as_of
  FROM companies LEFT JOIN g USING (ticker) LEFT JOIN last USING (ticker) CROSS JOIN clock)
SELECT *, {_ratio_sql('d7_')}, {_ratio_sql('d30_')}, {r('d30_articles / 30.0', 4)} AS articles_per_day, as_of - latest_date AS latest_age_days, row_number() OVER (ORDER BY d30_articles DESC, ticker) AS volume_rank FROM z"""
register("n_summary", lambda s, d: nw.news_summary(_rel(s, d), fx.companies(s, d)), f"{_BASE}, {NEWS_SUMMARY}")
register("n_coverage", lambda s, d: nw.coverage(_rel(s, d)), f"{_BASE} SELECT ticker, strftime(published_date, '%Y-%m') AS month, min(published_date) AS first_date, max(published_date) AS last_date, count(DISTINCT article_id) AS articles FROM rel GROUP BY ALL")


def _events(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).where("is_anomaly")


def _links(s: SparkSession, d: str, by_date: bool = True) -> DataFrame:
    return im.impact(_events(s, d), im.article_tickers(fx.news(s, d)), by_date=by_date)


ARTICLES = """
art0 AS (SELECT *, unnest(CASE WHEN len(coalesce(tickers, [])) = 0 THEN [requested_ticker] ELSE tickers END) AS ticker FROM news),
articles AS (
  SELECT article_id, ticker, requested_ticker AS requesters, title, description, publisher_name, published_utc, CAST(published_utc AS DATE) AS published_date, coalesce(len(tickers), 0) AS ticker_count,
    CASE WHEN list_contains(tickers, ticker) THEN 'ARTICLE_TICKERS' ELSE 'REQUESTED_TICKER_FALLBACK' END AS ticker_source,
    CASE WHEN coalesce(list_contains(tickers, ticker), false) AND insights IS NOT NULL AND sentiment IS NOT NULL THEN sentiment WHEN ticker = requested_ticker THEN sentiment END AS sentiment,
    CASE WHEN coalesce(list_contains(tickers, ticker), false) AND insights IS NOT NULL THEN title END AS reasoning,
    CASE WHEN coalesce(list_contains(tickers, ticker), false) AND insights IS NOT NULL AND sentiment IS NOT NULL THEN 'INSIGHTS' WHEN ticker = requested_ticker AND sentiment IS NOT NULL THEN 'REQUESTED_TICKER' ELSE 'NONE' END AS sentiment_source
  FROM art0)"""
LINKS = """
ev AS (SELECT event_id, ticker, date AS event_date, severity FROM anomalies WHERE is_anomaly),
l1 AS (SELECT ev.*, a.* EXCLUDE (ticker), published_date - event_date AS day_offset,
    CASE sentiment WHEN 'positive' THEN 1.0 WHEN 'neutral/positive' THEN 0.5 WHEN 'neutral' THEN 0.0 WHEN 'mixed' THEN 0.0 WHEN 'negative' THEN -1.0 END AS sentiment_score,
    CASE sentiment WHEN 'positive' THEN 'POSITIVE' WHEN 'neutral/positive' THEN 'POSITIVE' WHEN 'neutral' THEN 'NEUTRAL' WHEN 'mixed' THEN 'MIXED' WHEN 'negative' THEN 'NEGATIVE' ELSE 'UNKNOWN' END AS sentiment_bucket
  FROM ev JOIN articles a ON a.ticker = ev.ticker AND published_date BETWEEN event_date - 3 AND event_date + 3),
l2 AS (SELECT *, CASE WHEN day_offset < 0 THEN 'PRE_EVENT' WHEN day_offset = 0 THEN 'SAME_DAY' ELSE 'POST_EVENT' END AS event_relation,
    CASE WHEN day_offset = -1 THEN 'DAY_BEFORE' WHEN day_offset = 0 THEN 'SAME_DAY' WHEN day_offset = 1 THEN 'DAY_AFTER' WHEN day_offset < 0 THEN 'PRE_EVENT' ELSE 'POST_EVENT' END AS temporal_relation,
    day_offset <= 0 AS is_context, CASE abs(day_offset) WHEN 0 THEN 1.0 WHEN 1 THEN 0.85 WHEN 2 THEN 0.65 WHEN 3 THEN 0.5 ELSE 0.0 END::DOUBLE AS temporal_weight FROM l1),
links AS (SELECT *, sentiment_score * temporal_weight AS weighted_score, CASE WHEN is_context THEN sentiment_score * temporal_weight END AS context_score,
    CASE WHEN temporal_weight >= 1 THEN 'VERY_HIGH' WHEN temporal_weight >= 0.85 THEN 'HIGH' WHEN temporal_weight >= 0.65 THEN 'MEDIUM' ELSE 'LOW' END AS relevance_bucket FROM l2)"""
_EV = f"WITH {METRICS}, {ANOMALIES}, {fx.NEWS}, {ARTICLES}, {LINKS}"
_LINK_COLUMNS = ["event_id", "article_id", "ticker", "event_date", "published_date", "day_offset", "requesters", "ticker_source", "sentiment_source", "ticker_count", "event_relation", "temporal_relation", "is_context", "sentiment_bucket", "relevance_bucket"]


def _shown(df: DataFrame) -> DataFrame:
    return df.select(*_LINK_COLUMNS, *[F.round(c, 4).alias(c) for c in ("temporal_weight", "weighted_score", "context_score")])


_LINK_SQL = f"{_EV} SELECT {', '.join(_LINK_COLUMNS)}, " + ", ".join(f"{r(c, 4)} AS {c}" for c in ("temporal_weight", "weighted_score", "context_score")) + " FROM links"
register("i_impact", lambda s, d: _shown(_links(s, d)), _LINK_SQL)
register("i_impact_range_join", lambda s, d: _shown(_links(s, d, False)), _LINK_SQL)
SUMMARY = f"""
s1 AS (SELECT event_id, count(DISTINCT article_id) AS news, count(*) FILTER (is_context) AS context_news, count(*) FILTER (event_relation = 'PRE_EVENT') AS pre, count(*) FILTER (event_relation = 'SAME_DAY') AS same,
    count(*) FILTER (event_relation = 'POST_EVENT') AS post, {', '.join(f"count(*) FILTER (sentiment_bucket = '{x}') AS {x.lower()}" for x in ('POSITIVE', 'NEGATIVE', 'NEUTRAL', 'MIXED', 'UNKNOWN'))},
    {r('avg(sentiment_score)', 4)} AS avg_sentiment, {r('avg(weighted_score)', 4)} AS avg_weighted, {r('avg(context_score)', 4)} AS avg_context, max(temporal_weight) AS max_weight FROM links GROUP BY event_id),
s2 AS (SELECT ev.event_id, ticker, event_date, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('news', 'context_news', 'pre', 'same', 'post', 'positive', 'negative', 'neutral', 'mixed', 'unknown'))}, avg_sentiment, avg_weighted, avg_context, max_weight FROM ev LEFT JOIN s1 USING (event_id)),
summary AS (SELECT *, news > 0 AS has_news, context_news > 0 AS has_context,
    CASE WHEN news = 0 THEN 'NO_NEWS' WHEN greatest(positive, negative, neutral, mixed) = 0 THEN 'UNKNOWN'
      WHEN list_count(list_filter([positive, negative, neutral, mixed], lambda x: x = greatest(positive, negative, neutral, mixed))) > 1 THEN 'MIXED'
      WHEN positive = greatest(positive, negative, neutral, mixed) THEN 'POSITIVE' WHEN negative = greatest(positive, negative, neutral, mixed) THEN 'NEGATIVE' WHEN neutral = greatest(positive, negative, neutral, mixed) THEN 'NEUTRAL' ELSE 'MIXED' END AS dominant,
    CASE WHEN news = 0 THEN 'NO_COVERAGE' WHEN news <= 2 THEN 'LOW' WHEN news <= 5 THEN 'MEDIUM' ELSE 'HIGH' END AS coverage,
    CASE WHEN context_news = 0 THEN 'NO_CONTEXT' WHEN context_news <= 2 THEN 'LOW' WHEN context_news <= 5 THEN 'MEDIUM' ELSE 'HIGH' END AS context_coverage FROM s2)"""


def _summary(s: SparkSession, d: str) -> DataFrame:
    return im.impact_summary(_links(s, d), _events(s, d))


register("i_summary", _summary, f"{_EV}, {SUMMARY} SELECT * FROM summary")
register("i_coverage_by_key", lambda s, d: im.coverage_by_key(_summary(s, d)), f"{_EV}, {SUMMARY} SELECT ticker, count(*) AS events, count(*) FILTER (has_news) AS with_news, count(*) FILTER (has_context) AS with_context, CAST(sum(news) AS BIGINT) AS links, {r('100.0 * count(*) FILTER (has_news) / count(*)', 4)} AS news_pct FROM summary GROUP BY ticker")

RANKED = """
q1 AS (SELECT links.*, coalesce(regexp_matches(lower(coalesce(title, '')), pattern), false) AS title_match, coalesce(regexp_matches(lower(coalesce(description, '')), pattern), false) AS description_match FROM links LEFT JOIN patterns USING (ticker)),
q2 AS (SELECT *, round(CAST(temporal_weight * 25 AS DECIMAL(20, 6)) + CASE event_relation WHEN 'SAME_DAY' THEN 15.0 WHEN 'PRE_EVENT' THEN 12.0 ELSE 4.0 END + CASE WHEN title_match THEN 25.0 ELSE 0.0 END + CASE WHEN description_match THEN 10.0 ELSE 0.0 END
    + CASE WHEN ticker_count = 1 THEN 10.0 WHEN ticker_count = 2 THEN 8.0 WHEN ticker_count = 3 THEN 6.0 WHEN ticker_count <= 5 THEN 4.0 WHEN ticker_count <= 10 THEN 2.0 ELSE 1.0 END
    + CASE sentiment_source WHEN 'INSIGHTS' THEN 5.0 WHEN 'REQUESTED_TICKER' THEN 3.0 ELSE 0.0 END + CASE WHEN length(trim(reasoning, ' ')) >= 20 THEN 5.0 WHEN length(trim(reasoning, ' ')) > 0 THEN 3.0 ELSE 0.0 END
    + CASE WHEN title IS NOT NULL AND length(trim(description, ' ')) >= 50 THEN 5.0 WHEN title IS NOT NULL AND description IS NOT NULL THEN 4.0 WHEN title IS NOT NULL THEN 3.0 ELSE 0.0 END, 2)::DOUBLE AS relevance_score FROM q1),
q3 AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY relevance_score DESC, title_match DESC, description_match DESC, temporal_weight DESC, abs(day_offset), published_utc DESC, article_id) AS news_rank,
    CASE WHEN is_context THEN row_number() OVER (PARTITION BY event_id, is_context ORDER BY relevance_score DESC, title_match DESC, description_match DESC, temporal_weight DESC, abs(day_offset), published_utc DESC, article_id) END AS context_rank FROM q2),
ranked AS (SELECT *, CASE WHEN title_match AND description_match THEN 'TITLE_AND_DESCRIPTION' WHEN title_match THEN 'TITLE' WHEN description_match THEN 'DESCRIPTION' ELSE 'NONE' END AS match_level,
    CASE WHEN relevance_score >= 85 THEN 'VERY_HIGH' WHEN relevance_score >= 70 THEN 'HIGH' WHEN relevance_score >= 55 THEN 'MEDIUM' ELSE 'LOW' END AS tier,
    CASE WHEN coalesce(context_rank <= 5, false) THEN 'PRIMARY_CONTEXT' WHEN news_rank <= 10 AND event_relation = 'POST_EVENT' THEN 'REACTION' WHEN news_rank <= 10 THEN 'SECONDARY_CONTEXT' ELSE 'BACKGROUND' END AS usage_class,
    CASE WHEN title_match AND description_match THEN 'DIRECT' WHEN title_match THEN 'DIRECT_TITLE' WHEN description_match THEN 'DIRECT_DESCRIPTION' ELSE 'INDIRECT' END AS directness FROM q3)"""
_RANK_COLUMNS = ["event_id", "article_id", "ticker", "title_match", "description_match", "match_level", "relevance_score", "tier", "news_rank", "context_rank", "usage_class", "directness"]
_RK = f"{_EV}, {fx.PATTERNS}, {RANKED}"


def ranked(s: SparkSession, d: str) -> DataFrame:
    return im.relevance(_links(s, d), fx.patterns(s, d))


register("r_relevance", lambda s, d: ranked(s, d).select(*_RANK_COLUMNS), f"{_RK} SELECT {', '.join(_RANK_COLUMNS)} FROM ranked")
register("r_top_news", lambda s, d: im.top_news(ranked(s, d)).select(*_RANK_COLUMNS), f"{_RK} SELECT {', '.join(_RANK_COLUMNS)} FROM ranked WHERE news_rank <= 10 OR context_rank <= 5")
register("r_quality", lambda s, d: im.ranking_quality(ranked(s, d)), f"{_RK} SELECT ticker, count(DISTINCT event_id) AS events, count(*) AS links, {r('100.0 * count(*) FILTER (title_match) / count(*)', 4)} AS title_pct, max(relevance_score) AS max_score, min(relevance_score) AS min_score, {r('sum(relevance_score) / count(*)', 4)} AS avg_score FROM ranked GROUP BY ticker")
