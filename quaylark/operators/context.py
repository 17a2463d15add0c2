"""Research context: all that the library knows of a watched key, as one nested document.

A document has eight parts: company, market, performance, technical, the news summary with the
last news days, and the last events with what the news around them says. Each is made once a
key, whatever the number of users that watch it, and joined to the watched pairs at the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, NumericType, StructType

from quaylark.functions.columns import latest

#: Columns of each part, in the order of the document.
PARTS = {
    "company": ("name", "market_cap", "market_cap_billions", "total_employees", "list_date", "years_listed"),
    "market": ("date", "open", "high", "low", "close", "volume", "vwap", "transactions", "previous_close", "price_change", "daily_return", "daily_return_pct", "ma_short", "ma_long", "volume_avg", "volume_ratio", "annual_volatility_pct", "range_pct", "close_vs_vwap_pct", "direction"),
    "performance": (
        "company_name", "date", "close", "return_7d", "return_30d", "return_90d", "return_252d", "total_return", "high_52w", "low_52w", "from_high_pct", "from_low_pct", "volatility", "momentum_10_pct",
        "trend_signal", "rsi_signal", "macd_state", "composite", "performance_rank", "category"),
    "technical": (
        "date", "close", "sma_20", "sma_50", "ema_12", "ema_26", "rsi_14", "macd", "macd_signal", "macd_histogram", "bollinger_middle", "bollinger_upper", "bollinger_lower", "bollinger_width_pct", "bollinger_position",
        "momentum_10_pct", "price_vs_sma_20_pct", "price_vs_sma_50_pct", "trend_signal", "rsi_signal", "macd_state"),
    "summary": (
        "as_of", "articles", "d7_articles", "d30_articles", "d30_positive", "d30_negative", "d30_neutral", "d30_score", "d30_coverage_pct", "d30_positive_pct", "d30_negative_pct", "d30_neutral_pct", "d30_dominant", "d30_publishers",
        "articles_per_day", "volume_rank", "latest_article", "latest_title", "latest_date", "latest_age_days"),
    "recent_daily": ("published_date", "articles", "positive", "negative", "neutral", "score", "coverage_pct", "positive_pct", "negative_pct", "neutral_pct", "dominant", "publishers"),
    "recent": (
        "date", "event_id", "close", "daily_return", "direction", "gap_pct", "return_7d", "return_20d", "return_30d", "drawdown_60_pct", "rsi", "return_z", "volume_z", "range_z", "gap_z", "transactions_z", "volatility_ratio",
        "is_return", "is_volume", "is_range", "is_gap", "is_transactions", "is_volatility", "signal_count", "anomaly_score", "severity", "explanation", "market_condition"),
    "news_context": (
        "event_date", "event_id", "anomaly_score", "severity", "explanation", "market_condition", "has_news", "has_context", "news", "pre", "same", "post", "context_news", "positive", "negative", "neutral",
        "avg_sentiment", "avg_weighted", "dominant", "max_weight", "coverage", "context_coverage"),
}

#: Events that a context shows, unless told otherwise.
EVENTS = 5
LEAVES = "array<struct<path:string,number:double,text:string>>"


def _part(df: DataFrame, name: str, digits: int) -> Column:
    """A part's struct; doubles have as many digits as the document shows."""
    kinds = {f.name: f.dataType for f in df.schema}
    short = lambda c: F.round(F.round(c, 9), digits).alias(c) if isinstance(kinds[c], DoubleType) else F.col(c)
    return F.struct(*[short(c) for c in PARTS[name]])


def key_contexts(
    keys: DataFrame, *, companies: DataFrame, metrics: DataFrame, performance: DataFrame, indicators: DataFrame, summary: DataFrame, daily: DataFrame, events: DataFrame, impacts: DataFrame,
    days: int = 7, n_events: int = EVENTS, digits: int = 4, key: str = "ticker",
) -> DataFrame:
    """One row for each of the distinct keys: a struct of each part, null where nothing is
    known; the lists have at most `days` news days and `n_events` events, newest first, and are
    empty where there are none. `metrics` and `indicators` are cut to their newest row,
    `companies`, `performance` and `summary` have one row a key; `impacts` has one row an event.
    Lists are cut by rank before they are gathered, so that no group is larger than they are."""
    keys = keys.select(key).where(F.col(key).isNotNull()).distinct()
    own = lambda df: df.join(keys, key, "left_semi")
    last = lambda df, ts, n=1: latest(own(df), key, [F.col(ts).desc()], n=n)

    def one(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, _part(df, name, digits).alias(name))

    def several(df: DataFrame, name: str) -> DataFrame:
        # The first column of a list's part is its day.
        return one(df, name).groupBy(key).agg(F.reverse(F.array_sort(F.collect_list(name))).alias(name))

    newest = last(events.where("is_anomaly"), "date", n_events)
    told = last(impacts, "event_date", n_events).join(newest.select("event_id", "anomaly_score", "severity", "explanation", "market_condition"), "event_id", "left")
    parts = [
        one(own(companies), "company"), one(last(metrics, "date"), "market"), one(own(performance), "performance"), one(last(indicators, "date"), "technical"),
        one(own(summary), "summary"), several(last(daily, "published_date", days), "recent_daily"), several(newest, "recent"), several(told, "news_context"),
    ]
    df = keys
    for p in parts:
        df = df.join(p, key, "left")
    listed = lambda c: F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)).alias(c)
    return df.select(key, "company", "market", "performance", "technical", F.struct("summary", listed("recent_daily")).alias("news"), F.struct(listed("recent"), listed("news_context")).alias("anomalies"))


def research_context(watch: DataFrame, users: DataFrame, contexts: DataFrame, *, user: str = "user_id", key: str = "ticker") -> DataFrame:
    """(user, key, the user's own columns, the key's context) for each watched pair."""
    names = users.select(user, F.struct(*users.columns).alias("user"))
    return watch.select(user, key).join(names, user, "left").join(contexts, key, "left").select(user, key, "user", *[c for c in contexts.columns if c != key])


def dealt(watch: DataFrame, user: str = "user_id") -> DataFrame:
    """The watched pairs over all shuffle partitions: they are small, their documents aren't."""
    return watch.repartition(int(watch.sparkSession.conf.get("spark.sql.shuffle.partitions")), user)


def pair_leaves(
    watch: DataFrame, users: DataFrame, contexts: DataFrame, read: Callable[[DataFrame, list[str]], DataFrame], *, store: Callable[[DataFrame], DataFrame] = lambda df: df, user: str = "user_id", key: str = "ticker",
) -> DataFrame:
    """(user, key, path, number, text): the values that `read(df, keys)` finds in the research
    context of each watched pair. A user's part is read once a user and a key's parts once a key,
    as no path leads through both; the context of a pair then has the values found. Both have one
    row a user and a key. `store` keeps the values of the keys."""
    gathered = lambda leaves, by, name: leaves.groupBy(by).agg(F.collect_list(F.struct("path", "number", "text")).alias(name))
    own = gathered(read(users.select(user, F.struct(*users.columns).alias("user")), [user]), user, "own")
    shared = store(gathered(read(contexts, [key]), key, "shared"))
    pairs = research_context(dealt(watch, user), own.hint("merge"), shared, user=user, key=key)
    known = [F.coalesce(c, F.array().cast(LEAVES)) for c in ("user.own", "shared")]
    return pairs.select(user, key, F.explode(F.concat(*known)).alias("leaf")).select(user, key, "leaf.*")


def as_json(context: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, document): the other columns as one compact JSON text; nulls are left out."""
    return context.select(*keys, F.to_json(F.struct(*[c for c in context.columns if c not in keys])).alias("document"))


def _leaves(value: Column, kind: DataType, path: Column) -> Column:
    """(path, number, text) of all known values inside a value of this type."""
    if isinstance(kind, StructType):
        found = F.concat(*[_leaves(value[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}"))) for f in kind.fields])
    elif isinstance(kind, ArrayType):
        found = F.flatten(F.transform(value, lambda x, i: _leaves(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
    else:
        number = isinstance(kind, NumericType)
        leaf = F.struct(path.alias("path"), (value.cast("double") if number else F.lit(None).cast("double")).alias("number"), (F.lit(None).cast("string") if number else value.cast("string")).alias("text"))
        found = F.when(value.isNotNull(), F.array(leaf))
    return F.coalesce(found, F.array().cast(LEAVES))


def context_leaves(context: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, number, text): one row for each known value of the other columns."""
    found = [_leaves(F.col(f.name), f.dataType, F.lit(f"$.{f.name}")) for f in context.schema if f.name not in keys]
    return context.select(*keys, F.explode(F.concat(*found)).alias("leaf")).select(*keys, "leaf.*")


def document_leaves(documents: DataFrame, keys: list[str], *, depth: int = 6, document: str = "document") -> DataFrame:
    """(keys, path, number, text) of JSON texts of any shape, read as VARIANT: one row for each
    value that isn't null, empty or nested deeper than `depth`. Unreadable texts give none."""
    df = documents.select(*keys, F.lit("$").alias("path"), F.try_parse_json(F.col(document)).alias("v")).where("v is not null")
    spark = documents.sparkSession
    for _ in range(depth):
        inner = spark.tvf.variant_explode_outer(F.col("v").outer())
        kind = F.schema_of_variant("v")
        nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        step = F.coalesce(F.concat(F.lit("."), F.col("key")), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        inside = F.col("pos").isNotNull()
        df = df.lateralJoin(inner).select(*keys, F.when(inside, F.concat("path", step)).otherwise(F.col("path")).alias("path"), F.when(inside, F.col("value")).when(~nested, F.col("v")).alias("v")).where("v is not null")
    kind = F.schema_of_variant("v")
    text = kind.isin("STRING", "BOOLEAN")
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    value = lambda to: F.try_variant_get("v", "$", to)
    return df.where(text | number).select(*keys, "path", F.when(number, value("double")).alias("number"), F.when(text, value("string")).alias("text"))
