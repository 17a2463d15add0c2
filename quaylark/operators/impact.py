"""News around events: an interval join, temporal weights, roll-ups, ranked relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylark.functions.columns import bands, flag
from quaylark.operators.news import first_insight

# Weights by day, sentiment scores, points of the relevance score.
DAY_WEIGHT = {0: 1.0, 1: 0.85, 2: 0.65, 3: 0.50}
SENTIMENT_SCORE = {"positive": 1.0, "neutral/positive": 0.5, "neutral": 0.0, "mixed": 0.0, "negative": -1.0}
BUCKETS = {"positive": "POSITIVE", "neutral/positive": "POSITIVE", "neutral": "NEUTRAL", "mixed": "MIXED", "negative": "NEGATIVE"}
RELATION_POINTS = {"SAME_DAY": 15.0, "PRE_EVENT": 12.0, "POST_EVENT": 4.0}
SPECIFICITY = ((1, 10.0), (2, 8.0), (3, 6.0), (5, 4.0), (10, 2.0))
RELEVANCE = ((1.0, "VERY_HIGH"), (0.85, "HIGH"), (0.65, "MEDIUM"))
TIERS = ((85.0, "VERY_HIGH"), (70.0, "HIGH"), (55.0, "MEDIUM"))


def _choose(col: Column, values: dict, otherwise=None) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(col == k, v) if out is None else out.when(col == k, v)
    return out.otherwise(otherwise)


def article_tickers(news: DataFrame) -> DataFrame:
    """One row for each article and ticker that it names, or was requested for if it names
    none, with where the ticker and its sentiment come from.

    Copies of an article requested for several tickers meet: requesters are gathered, and
    the first copy by requester gives the other values.
    """
    df = news.withColumn("ticker", F.explode_outer("tickers"))
    df = df.withColumn("ticker", F.trim(F.coalesce("ticker", "requested_ticker"))).where("ticker is not null")
    own = first_insight(F.col("insights"), F.col("ticker"))
    asked = F.col("ticker") == F.col("requested_ticker")
    df = df.withColumns({"named": flag(F.array_contains("tickers", F.col("ticker"))), "_told": own["sentiment"], "reasoning": own["sentiment_reasoning"]})
    df = df.withColumns({
        "sentiment": F.coalesce("_told", F.when(asked, F.col("sentiment"))),
        "sentiment_source": F.when(F.col("_told").isNotNull(), "INSIGHTS").when(asked & F.col("sentiment").isNotNull(), "REQUESTED_TICKER").otherwise("NONE"),
        "ticker_source": F.when(F.col("named"), "ARTICLE_TICKERS").otherwise("REQUESTED_TICKER_FALLBACK"),
        "ticker_count": F.coalesce(F.size("tickers"), F.lit(0)),
    })
    keep = ["title", "description", "publisher_name", "published_utc", "sentiment", "reasoning", "sentiment_source", "ticker_source", "ticker_count"]
    return df.groupBy("article_id", "ticker").agg(F.array_join(F.array_sort(F.collect_set("requested_ticker")), ",").alias("requesters"), *[F.min_by(c, "requested_ticker").alias(c) for c in keep])


def impact(events: DataFrame, articles: DataFrame, *, days: int = 3, by_date: bool = True) -> DataFrame:
    """Articles within `days` of an event of their ticker.

    With `by_date` each event is repeated for its days and joined on (ticker, date): every
    key is small, whatever the number of events of a ticker. Without it the join is on
    ticker with the range as a condition, which suits few events a ticker.
    """
    e = events.select("event_id", "ticker", F.col("date").alias("event_date"), "anomaly_score", "severity")
    a = articles.withColumn("published_date", F.to_date("published_utc"))
    if by_date:
        e = e.withColumn("published_date", F.explode(F.sequence(F.date_sub("event_date", days), F.date_add("event_date", days))))
        df = e.join(a, ["ticker", "published_date"])
    else:
        a = a.withColumnRenamed("ticker", "_t")
        df = e.join(a, (e["ticker"] == a["_t"]) & a["published_date"].between(F.date_sub("event_date", days), F.date_add("event_date", days))).drop("_t")
    off = F.datediff("published_date", "event_date")
    s = F.lower(F.trim("sentiment"))
    df = df.withColumns({"day_offset": off, "sentiment_score": _choose(s, SENTIMENT_SCORE), "sentiment_bucket": _choose(s, BUCKETS, "UNKNOWN")})
    o = F.col("day_offset")
    df = df.withColumns({
        "event_relation": F.when(o < 0, "PRE_EVENT").when(o == 0, "SAME_DAY").otherwise("POST_EVENT"),
        "temporal_relation": F.when(o == -1, "DAY_BEFORE").when(o == 0, "SAME_DAY").when(o == 1, "DAY_AFTER").when(o < 0, "PRE_EVENT").otherwise("POST_EVENT"),
        "is_context": o <= 0,
        "temporal_weight": _choose(F.abs(o), DAY_WEIGHT, 0.0),
    })
    w = F.col("sentiment_score") * F.col("temporal_weight")
    return df.withColumns({"weighted_score": w, "context_score": F.when(F.col("is_context"), w), "relevance_bucket": bands(F.col("temporal_weight"), RELEVANCE, "LOW")}).dropDuplicates(["event_id", "article_id"])


def _coverage(n: Column, none: str) -> Column:
    return F.when(n == 0, none).when(n <= 2, "LOW").when(n <= 5, "MEDIUM").otherwise("HIGH")


def impact_summary(links: DataFrame, events: DataFrame) -> DataFrame:
    """One row for each event, also those without news."""
    c = lambda cond: F.count_if(cond)
    b = F.col("sentiment_bucket")
    four = lambda x: F.round(F.round(F.avg(x), 9), 4)
    agg = links.groupBy("event_id").agg(
        F.count_distinct("article_id").alias("news"), c(F.col("is_context")).alias("context_news"), c(F.col("event_relation") == "PRE_EVENT").alias("pre"), c(F.col("event_relation") == "SAME_DAY").alias("same"), c(F.col("event_relation") == "POST_EVENT").alias("post"),
        *[c(b == x).alias(x.lower()) for x in ("POSITIVE", "NEGATIVE", "NEUTRAL", "MIXED", "UNKNOWN")],
        four("sentiment_score").alias("avg_sentiment"), four("weighted_score").alias("avg_weighted"), four("context_score").alias("avg_context"), F.max("temporal_weight").alias("max_weight"),
    )
    df = events.select("event_id", "ticker", F.col("date").alias("event_date")).join(agg, "event_id", "left")
    df = df.fillna(0, subset=["news", "context_news", "pre", "same", "post", "positive", "negative", "neutral", "mixed", "unknown"])
    p, n, u, m = (F.col(x) for x in ("positive", "negative", "neutral", "mixed"))
    top = F.greatest(p, n, u, m)
    ties = sum((F.when(x == top, 1).otherwise(0) for x in (p, n, u, m)), F.lit(0))
    dominant = F.when(F.col("news") == 0, "NO_NEWS").when(top == 0, "UNKNOWN").when(ties > 1, "MIXED").when(p == top, "POSITIVE").when(n == top, "NEGATIVE").when(u == top, "NEUTRAL").otherwise("MIXED")
    return df.withColumns({"has_news": F.col("news") > 0, "has_context": F.col("context_news") > 0, "dominant": dominant, "coverage": _coverage(F.col("news"), "NO_COVERAGE"), "context_coverage": _coverage(F.col("context_news"), "NO_CONTEXT")})


def coverage_by_key(summary: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return summary.groupBy("ticker").agg(n.alias("events"), F.count_if("has_news").alias("with_news"), F.count_if("has_context").alias("with_context"), F.sum("news").alias("links"), F.round(100.0 * F.count_if("has_news") / n, 4).alias("news_pct"))


def relevance(links: DataFrame, patterns: DataFrame) -> DataFrame:
    """links with matches of their ticker's pattern, score of eight parts (0 to 100), tier,
    rank in the event, rank among context news, use and directness.

    Both ranks come from windows over one event; the pattern table has one row a key.
    """
    df = links.join(patterns, "ticker", "left")
    hit = lambda c: flag(F.rlike(F.lower(F.coalesce(F.col(c), F.lit(""))), F.col("pattern")))
    df = df.withColumns({"title_match": hit("title"), "description_match": hit("description")})
    t, d = F.col("title_match"), F.col("description_match")
    size = None
    for n, points in SPECIFICITY:
        size = F.when(F.col("ticker_count") == n, points) if size is None else size.when((F.col("ticker_count") == n) if n <= 3 else (F.col("ticker_count") <= n), points)
    size = size.when(F.col("ticker_count") > 10, 1.0).otherwise(0.0)
    length = lambda c: F.length(F.trim(c))
    text = F.col("title").isNotNull()
    df = df.withColumn("relevance_score", F.round(
        F.col("temporal_weight") * 25 + _choose(F.col("event_relation"), RELATION_POINTS, 0.0) + F.when(t, 25.0).otherwise(0.0) + F.when(d, 10.0).otherwise(0.0) + size
        + F.when(F.col("sentiment_source") == "INSIGHTS", 5.0).when(F.col("sentiment_source") == "REQUESTED_TICKER", 3.0).otherwise(0.0)
        + F.when(length("reasoning") >= 20, 5.0).when(length("reasoning") > 0, 3.0).otherwise(0.0)
        + F.when(text & (length("description") >= 50), 5.0).when(text & F.col("description").isNotNull(), 4.0).when(text, 3.0).otherwise(0.0), 2))
    order = [F.col("relevance_score").desc(), t.desc(), d.desc(), F.col("temporal_weight").desc(), F.abs("day_offset"), F.col("published_utc").desc(), F.col("article_id")]
    df = df.withColumns({
        "match_level": F.when(t & d, "TITLE_AND_DESCRIPTION").when(t, "TITLE").when(d, "DESCRIPTION").otherwise("NONE"),
        "tier": bands(F.col("relevance_score"), TIERS, "LOW"),
        "news_rank": F.row_number().over(Window.partitionBy("event_id").orderBy(*order)),
        "context_rank": F.when(F.col("is_context"), F.row_number().over(Window.partitionBy("event_id", "is_context").orderBy(*order))),
    })
    top10, top5 = F.col("news_rank") <= 10, flag(F.col("context_rank") <= 5)
    return df.withColumns({
        "usage_class": F.when(top5, "PRIMARY_CONTEXT").when(top10 & (F.col("event_relation") == "POST_EVENT"), "REACTION").when(top10, "SECONDARY_CONTEXT").otherwise("BACKGROUND"),
        "directness": F.when(t & d, "DIRECT").when(t, "DIRECT_TITLE").when(d, "DIRECT_DESCRIPTION").otherwise("INDIRECT"),
    })


def top_news(ranked: DataFrame, *, k: int = 10, k_context: int = 5) -> DataFrame:
    return ranked.where((F.col("news_rank") <= k) | flag(F.col("context_rank") <= k_context))


def ranking_quality(ranked: DataFrame) -> DataFrame:
    """Per ticker, from per-event values: events, links, matches and scores."""
    per = ranked.groupBy("ticker", "event_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("title_match").alias("t"), F.max("relevance_score").alias("best"), F.min("relevance_score").alias("worst"), F.sum("relevance_score").alias("total"))
    n = F.sum("n")
    return per.groupBy("ticker").agg(F.count(F.lit(1)).alias("events"), n.alias("links"), F.round(100.0 * F.sum("t") / n, 4).alias("title_pct"), F.max("best").alias("max_score"), F.min("worst").alias("min_score"), F.round(F.round(F.sum("total") / n, 9), 4).alias("avg_score"))


def ranking_levels(top: DataFrame) -> DataFrame:
    """Top news of each event, rolled up per ticker and over all (level, ticker): events, least,
    mean and most top news, context news, direct and title matches of an event, and scores."""
    per = top.groupBy("ticker", "event_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(flag(F.col("context_rank") <= 5)).alias("context"), F.count_if(F.col("match_level") != "NONE").alias("direct"), F.count_if("title_match").alias("title"),
        F.min("relevance_score").alias("worst"), F.max("relevance_score").alias("best"), F.sum("relevance_score").alias("total"))
    four = lambda x: F.round(F.round(x, 9), 4)
    spread = [f for c in ("n", "context", "direct", "title") for f in (F.min(c).alias(f"min_{c}"), four(F.avg(c)).alias(f"avg_{c}"), F.max(c).alias(f"max_{c}"))]
    rates = [four(100.0 * F.sum(c) / F.sum("n")).alias(f"{c}_pct") for c in ("direct", "title")]
    out = per.groupingSets([["ticker"], []], "ticker").agg(F.count(F.lit(1)).alias("events"), *spread, *rates, F.min("worst").alias("min_score"), four(F.sum("total") / F.sum("n")).alias("avg_score"), F.max("best").alias("max_score"), F.grouping_id().alias("_g"))
    return out.select(F.when(F.col("_g") == 0, "TICKER").otherwise("ALL").alias("level"), *[c for c in out.columns if c != "_g"])
