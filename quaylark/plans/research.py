"""Queries over the research context of each watched pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylark.functions.columns import latest
from quaylark.operators import anomalies as an
from quaylark.operators import clean as cl
from quaylark.operators import context as cx
from quaylark.operators import impact as im
from quaylark.operators import indicators as ti
from quaylark.operators import news as nw
from quaylark.operators import performance as pf
from quaylark.operators import serving as sv
from quaylark.operators.series import daily_metrics
from quaylark.plans.catalog import register
from quaylark.plans.market import ANOMALIES, INDICATORS, METRICS, PERFORMANCE, r
from quaylark.plans.newsroom import ARTICLES, DAILY, LINKS, NEWS_SUMMARY, REL, SUMMARY
from quaylark.sources import fixtures as fx
from quaylark.sources.shared import stored

KEYS = ["user_id", "ticker"]


def contexts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The watched pairs, the users, and the stored context of each key, which users share."""
    watch = fx.watchlist(s, d)
    # Lineitems are read once; what is made of a key's days is small beside them.
    bars = stored(fx.bars(s, d))
    firms, m, t = stored(fx.companies(s, d, bars)), stored(daily_metrics(bars, digits={})), stored(ti.indicators(bars))
    e, rel = stored(an.anomalies(m)), stored(nw.relations(fx.news(s, d), firms))
    # News is looked up for the events that a context shows.
    odd = latest(e.where("is_anomaly"), "ticker", [F.col("date").desc()], n=cx.EVENTS)
    impacts = im.impact_summary(im.impact(odd, im.article_tickers(fx.news(s, d))), odd)
    by_key = cx.key_contexts(
        watch, companies=cl.company_features(firms, fx.AS_OF), metrics=m, performance=pf.performance(m, t, firms), indicators=t, summary=nw.news_summary(rel, firms), daily=nw.news_daily(rel), events=e, impacts=impacts)
    users = fx.table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return watch, users, stored(by_key)


def _shown(leaves: DataFrame) -> DataFrame:
    return leaves.withColumn("number", F.round(F.round("number", 9), 4))


def leaf_rows(s: SparkSession, d: str) -> DataFrame:
    """What is known of each watched pair, value by value."""
    return cx.pair_leaves(*contexts(s, d), lambda df, keys: _shown(cx.context_leaves(df, keys)), store=stored)


def document_rows(s: SparkSession, d: str) -> DataFrame:
    """What a reader of the JSON documents finds in them."""
    return cx.pair_leaves(*contexts(s, d), lambda df, keys: _shown(cx.document_leaves(cx.as_json(df, keys), keys)), store=stored)


def source_counts(s: SparkSession, d: str) -> DataFrame:
    """Values and days that the context of each watched pair holds."""
    watch, users, by_key = contexts(s, d)
    # What two sides hold is united a pair at a time; no value is shuffled.
    held = sv.value_sets(users.select("user_id", F.struct("user_id", "name").alias("user")), ["user_id"])
    both = cx.research_context(cx.dealt(watch), held.hint("merge"), stored(sv.value_sets(by_key, ["ticker"])))
    united = lambda c, kind: F.array_union(*[F.coalesce(x, F.array().cast(f"array<{kind}>")) for x in (f"user.{c}", c)])
    df = both.select(*KEYS, united("values", "double").alias("v"), united("days", "date").alias("d")).where(F.size("v") > 0)
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return df.select(
        *KEYS, F.size("v").cast("long").alias("n_values"), F.round(F.round(total, 9), 4).alias("total"), F.size("d").cast("long").alias("n_days"), F.array_min("d").alias("first_day"), F.array_max("d").alias("last_day"))


def _struct(part: str, **other: str) -> str:
    return "{" + ", ".join(f"'{c}': {other.get(c, c)}" for c in cx.PARTS[part]) + "}"


_YEARS = f"CAST(floor((date_diff('month', list_date, DATE '{fx.AS_OF}') - CASE WHEN day(list_date) > day(DATE '{fx.AS_OF}') THEN 1 ELSE 0 END) / 12.0) AS BIGINT)"
_LAST = "QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY {} DESC) <= {}"
_TREE = f"""WITH RECURSIVE {METRICS}, {ANOMALIES}, {fx.COMPANIES}, {INDICATORS}, {PERFORMANCE}, {fx.NEWS}, {REL}, {ARTICLES}, {LINKS}, {SUMMARY}, {fx.WATCHLIST},
news_days AS (WITH {DAILY}), news_totals AS (WITH {NEWS_SUMMARY}),
c1 AS (SELECT ticker, {_struct('company', name='trim(name)', market_cap_billions=r('market_cap / 1e9', 4), years_listed=_YEARS)} AS x FROM companies),
c2 AS (SELECT ticker, {_struct('market')} AS x FROM metrics {_LAST.format('date', 1)}),
c3 AS (SELECT ticker, {_struct('performance')} AS x FROM perf),
c4 AS (SELECT ticker, {_struct('technical')} AS x FROM indicators {_LAST.format('date', 1)}),
c5 AS (SELECT ticker, {_struct('summary')} AS x FROM news_totals),
c6 AS (SELECT ticker, list({_struct('recent_daily')} ORDER BY published_date DESC) AS x FROM (SELECT * FROM news_days {_LAST.format('published_date', 7)}) GROUP BY ticker),
odd AS (SELECT * FROM anomalies WHERE is_anomaly {_LAST.format('date', 5)}),
c7 AS (SELECT ticker, list({_struct('recent')} ORDER BY date DESC) AS x FROM odd GROUP BY ticker),
heard AS (SELECT summary.*, anomaly_score, severity, explanation, market_condition FROM summary JOIN odd USING (event_id)),
c8 AS (SELECT ticker, list({_struct('news_context')} ORDER BY event_date DESC) AS x FROM heard GROUP BY ticker),
docs AS (
  SELECT user_id, ticker, to_json({{'user': {{'user_id': user_id, 'name': c_name}}, 'company': c1.x, 'market': c2.x, 'performance': c3.x, 'technical': c4.x,
    'news': {{'summary': c5.x, 'recent_daily': coalesce(c6.x, [])}}, 'anomalies': {{'recent': coalesce(c7.x, []), 'news_context': coalesce(c8.x, [])}}}}) AS doc
  FROM watchlist JOIN customer ON c_custkey = user_id {' '.join(f'LEFT JOIN c{i} USING (ticker)' for i in range(1, 9))}),
tree AS (SELECT user_id, ticker, t.fullkey AS path, t.type AS kind, t.value AS value, t.atom AS atom FROM docs, json_tree(doc) t WHERE t.type <> 'NULL'),
leaves AS (
  SELECT user_id, ticker, path, CASE WHEN kind IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN {r('CAST(atom AS DOUBLE)', 4)} END AS number,
    CASE WHEN kind = 'VARCHAR' THEN atom ->> '$' WHEN kind = 'BOOLEAN' THEN CAST(atom AS VARCHAR) END AS text, kind
  FROM tree WHERE kind NOT IN ('OBJECT', 'ARRAY'))"""
_LEAVES = f"{_TREE} SELECT user_id, ticker, path, number, text FROM leaves"
register("q_research_context", leaf_rows, _LEAVES)
register("q_context_json", document_rows, _LEAVES)
register("q_source_values", source_counts, f"""{_TREE},
vals AS (SELECT DISTINCT user_id, ticker, value FROM (
  SELECT user_id, ticker, number AS value FROM leaves WHERE number IS NOT NULL UNION ALL SELECT user_id, ticker, CAST(json_array_length(value) AS DOUBLE) FROM tree WHERE kind = 'ARRAY')),
days AS (SELECT DISTINCT user_id, ticker, day FROM (SELECT user_id, ticker, TRY_CAST(unnest(regexp_extract_all(text, '\\b([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})\\b', 1)) AS DATE) AS day FROM leaves WHERE kind = 'VARCHAR') WHERE day IS NOT NULL),
n AS (SELECT user_id, ticker, count(*) AS n_days, min(day) AS first_day, max(day) AS last_day FROM days GROUP BY ALL)
SELECT user_id, ticker, count(*) AS n_values, {r('sum(value)', 4)} AS total, coalesce(any_value(n_days), 0) AS n_days, any_value(first_day) AS first_day, any_value(last_day) AS last_day FROM vals LEFT JOIN n USING (user_id, ticker) GROUP BY user_id, ticker""")
