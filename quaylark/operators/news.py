"""News: cleaning, article-ticker relations, daily and trailing aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaylark.functions.columns import latest
from quaylark.operators.ranks import row_numbers

# The sentiments that daily analytics know.
SENTIMENTS = ("positive", "negative", "neutral")
TEXT = ("title", "author", "description", "article_url", "amp_url", "image_url", "publisher_name", "publisher_homepage_url")
INSIGHTS = "array<struct<ticker:string,sentiment:string,sentiment_reasoning:string>>"


def clean_news(raw: DataFrame) -> DataFrame:
    """Trimmed text, upper-case keys, parsed JSON with tidy members, own insight, validity.

    Malformed JSON becomes null and is told by bad_tickers, bad_insights and, if raw has
    keywords, bad_keywords. Rows that fail a rule stay, with valid = false.
    """
    df = raw.withColumns({"requested_ticker": F.upper(F.trim("requested_ticker"))} | {c: F.trim(c) for c in TEXT if c in raw.columns})
    if "keywords_json" in raw.columns:
        df = df.withColumn("_k", F.from_json("keywords_json", "array<string>"))
        df = df.withColumns({"keywords": F.transform("_k", lambda k: F.trim(k)), "bad_keywords": F.col("keywords_json").isNotNull() & F.col("_k").isNull()})
    df = df.withColumns({"_t": F.from_json("tickers_json", "array<string>"), "_i": F.from_json("insights_json", INSIGHTS)})
    df = df.withColumns({
        "tickers": F.transform("_t", lambda t: F.upper(F.trim(t))),
        "insights": F.transform("_i", lambda x: F.struct(F.upper(F.trim(x["ticker"])).alias("ticker"), F.lower(F.trim(x["sentiment"])).alias("sentiment"), F.trim(x["sentiment_reasoning"]).alias("sentiment_reasoning"))),
        "bad_tickers": F.col("tickers_json").isNotNull() & F.col("_t").isNull(),
        "bad_insights": F.col("insights_json").isNotNull() & F.col("_i").isNull(),
        "published_date": F.to_date("published_utc"),
    })
    own = first_insight(F.col("insights"), F.col("requested_ticker"))
    df = df.withColumns({"own_sentiment": own["sentiment"], "own_reasoning": own["sentiment_reasoning"]})
    ok = F.col("article_id").isNotNull() & F.col("requested_ticker").isNotNull() & (F.coalesce(F.col("title"), F.lit("")) != "") & F.col("published_utc").isNotNull()
    return df.withColumn("valid", F.coalesce(ok, F.lit(False))).drop("_t", "_i", "_k")


def duplicate_profile(news: DataFrame, keys: tuple[str, ...] = ("article_id", "requested_ticker"), *, top: int = 20) -> DataFrame:
    """One row: rows, different ids, different keys, and the `top` most repeated keys with
    their counts. Unknown parts of a key are a value of their own."""
    per = news.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    sums = per.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rows"), F.count_distinct(keys[0]).alias("n_ids"), F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("n") > 1).alias("repeated_keys"))
    often = per.where("n > 1").orderBy(F.col("n").desc(), *keys).limit(top)
    # At most `top` rows in one list.
    return sums.crossJoin(often.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), *keys))).alias("most")))


def first_insight(insights: Column, ticker: Column) -> Column:
    return F.get(F.filter(insights, lambda x: x["ticker"] == ticker), F.lit(0))


def relations(news: DataFrame, companies: DataFrame) -> DataFrame:
    """(article_id, ticker, sentiment, publisher_name, title, published_utc): one row for each
    pair; a pair's insight outranks its mere request. Only tickers of `companies`."""
    cols = ["article_id", "publisher_name", "title", "published_utc"]
    told = news.select(*cols, F.explode("insights").alias("i")).where("i.ticker is not null").select(*cols, F.trim("i.ticker").alias("ticker"), F.col("i.sentiment").alias("sentiment"), F.lit(1).alias("priority"))
    asked = news.select(*cols, F.trim("requested_ticker").alias("ticker"), F.lit(None).cast("string").alias("sentiment"), F.lit(0).alias("priority"))
    both = told.unionByName(asked).join(companies.select("ticker").distinct(), "ticker", "left_semi")
    both = latest(both, ["article_id", "ticker"], [F.col("priority").desc(), F.col("published_utc").desc(), F.col("sentiment").asc_nulls_last()])
    return both.withColumns({"sentiment": F.when(F.col("sentiment").isin(*SENTIMENTS), F.col("sentiment")), "published_date": F.to_date("published_utc")})


def _counts(when: Column | None = None) -> dict[str, Column]:
    keep = (lambda c: c) if when is None else (lambda c: F.when(when, c))
    out = {"articles": F.count_distinct(keep(F.col("article_id"))), "publishers": F.count_distinct(keep(F.col("publisher_name")))}
    for s in SENTIMENTS:
        out[s] = F.count_if((F.col("sentiment") == s) if when is None else (when & (F.col("sentiment") == s)))
    return out


def _ratios(prefix: str = "") -> dict[str, Column]:
    p, n, u, a = (F.col(f"{prefix}{c}") for c in ("positive", "negative", "neutral", "articles"))
    scored = p + n + u
    share = lambda x, of: F.round(F.round(F.try_divide(x * 100.0, of), 9), 4)
    top = F.greatest(p, n, u)
    alone = (F.when(p == top, 1).otherwise(0) + F.when(n == top, 1).otherwise(0) + F.when(u == top, 1).otherwise(0)) == 1
    label = F.when(scored == 0, "NO_DATA").when(alone & (p == top), "POSITIVE").when(alone & (n == top), "NEGATIVE").when(alone & (u == top), "NEUTRAL").otherwise("MIXED")
    return {f"{prefix}score": share(p - n, scored), f"{prefix}coverage_pct": share(scored, a), f"{prefix}positive_pct": share(p, scored), f"{prefix}negative_pct": share(n, scored), f"{prefix}neutral_pct": share(u, scored), f"{prefix}dominant": label}


def news_daily(rel: DataFrame) -> DataFrame:
    """Counts, shares and the strictly most frequent sentiment of each ticker and day."""
    c = _counts()
    return rel.groupBy("ticker", "published_date").agg(*[v.alias(k) for k, v in c.items()], F.max("published_utc").cast("string").alias("latest_utc")).withColumns(_ratios())


def news_summary(rel: DataFrame, companies: DataFrame, *, days: tuple[int, ...] = (7, 30)) -> DataFrame:
    """One row for each company: trailing windows up to the last day of all news, latest
    article, rate and age; companies without news count 0."""
    # One row, so its broadcast is bounded; the plan stays lazy.
    as_of = F.broadcast(rel.agg(F.max("published_date").alias("as_of")))
    df = rel.crossJoin(as_of)
    aggs = []
    for n in days:
        recent = F.col("published_date") >= F.date_sub("as_of", n - 1)
        aggs += [v.alias(f"d{n}_{k}") for k, v in _counts(recent).items()]
    sums = df.groupBy("ticker").agg(F.count_distinct("article_id").alias("articles"), *aggs)
    newest = latest(rel, "ticker", [F.col("published_utc").desc(), F.col("article_id").asc()]).select("ticker", F.col("article_id").alias("latest_article"), F.col("title").alias("latest_title"), F.to_date("published_utc").alias("latest_date"))
    out = companies.select("ticker").join(sums, "ticker", "left").join(newest, "ticker", "left").crossJoin(as_of)
    counts = [c for c in sums.columns if c != "ticker"]
    out = out.fillna(0, subset=counts)
    for n in days:
        out = out.withColumns(_ratios(f"d{n}_"))
    longest = max(days)
    out = out.withColumns({
        "articles_per_day": F.round(F.col(f"d{longest}_articles") / longest, 4), "latest_age_days": F.datediff("as_of", "latest_date"),
    })
    return row_numbers(out, [F.col(f"d{longest}_articles").desc(), F.col("ticker")], "volume_rank")


def parse_failures(cleaned: DataFrame) -> DataFrame:
    """One row: valid rows, and those of them whose JSON text doesn't parse, for each column."""
    bad = [c for c in ("bad_tickers", "bad_keywords", "bad_insights") if c in cleaned.columns]
    return cleaned.where("valid").agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(c).alias(c) for c in bad])


def coverage_levels(rel: DataFrame, events: DataFrame) -> DataFrame:
    """(level, ticker, month) with rows, first and last day of news and of events: for each
    ticker, for each month and over all, from one aggregate of grouping sets."""
    day = lambda df, c, is_news: df.select("ticker", F.col(c).alias("day"), F.lit(is_news).alias("is_news"))
    both = day(rel, "published_date", True).unionByName(day(events, "date", False)).withColumn("month", F.date_format("day", "yyyy-MM"))
    sides = (("news", F.col("is_news")), ("events", ~F.col("is_news")))
    aggs = [f(F.when(w, F.col("day"))).alias(f"{n}_{k}") for n, w in sides for k, f in (("rows", F.count), ("first", F.min), ("last", F.max))]
    out = both.groupingSets([["ticker"], ["month"], []], "ticker", "month").agg(*aggs, F.grouping_id().alias("_g"))
    return out.select(F.when(F.col("_g") == 1, "TICKER").when(F.col("_g") == 2, "MONTH").otherwise("ALL").alias("level"), "ticker", "month", *[f"{n}_{k}" for n, _ in sides for k in ("rows", "first", "last")])


def coverage(rel: DataFrame) -> DataFrame:
    """First and last day and articles of each ticker and month."""
    return rel.groupBy("ticker", F.date_format("published_date", "yyyy-MM").alias("month")).agg(F.min("published_date").alias("first_date"), F.max("published_date").alias("last_date"), F.count_distinct("article_id").alias("articles"))
