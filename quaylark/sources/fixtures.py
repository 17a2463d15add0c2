"""Market and news tables made from the driver's tables, as DataFrames and as DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A date after the last bar; operators that need a clock get it as an argument.
AS_OF = "2001-10-20"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: one row for each brand and ship date."""
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    p = F.col("p")
    rows = item.join(part, "l_partkey").withColumn("date", F.to_date("l_shipdate")).withColumn("p", F.col("l_extendedprice") / F.col("l_quantity")).withColumn("o", order)
    return rows.groupBy("ticker", "date").agg(
        F.min_by(p, "o").alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, "o").alias("close"),
        F.sum("l_quantity").alias("volume"), (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("vwap"), F.count(F.lit(1)).alias("transactions"),
    )


BARS = """
bars AS (
  SELECT ticker, date, first(p ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS open,
    max(p) AS high, min(p) AS low, last(p ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS close,
    sum(l_quantity) AS volume, sum(l_extendedprice) / sum(l_quantity) AS vwap, count(*) AS transactions
  FROM (SELECT l.*, p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS p
        FROM lineitem l JOIN part ON l_partkey = p_partkey)
  GROUP BY ticker, date)"""


def companies(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """One row a brand, and one brand more that has no bars. `known` are the bars, if at hand."""
    first = (bars(spark, sf_dir) if known is None else known).groupBy("ticker").agg(F.min("date").alias("list_date"))
    part = table(spark, sf_dir, "part")
    own = part.groupBy(F.col("p_brand").alias("ticker")).agg(F.sum("p_retailprice").alias("market_cap"), F.count(F.lit(1)).alias("total_employees"))
    own = own.join(first, "ticker", "left").withColumn("name", F.concat(F.lit(" "), F.col("ticker"), F.lit(" Inc ")))
    extra = part.agg(F.lit("Brand#99").alias("ticker"), F.lit(None).cast("double").alias("market_cap"), F.lit(0).cast("long").alias("total_employees"), F.lit(None).cast("date").alias("list_date"), F.lit("No Bars").alias("name"))
    return own.unionByName(extra)


COMPANIES = """
companies AS (
  SELECT p_brand AS ticker, sum(p_retailprice) AS market_cap, count(*) AS total_employees, min(list_date) AS list_date, ' ' || p_brand || ' Inc ' AS name
  FROM part LEFT JOIN (SELECT ticker, min(date) AS list_date FROM bars GROUP BY ticker) f ON p_brand = f.ticker
  GROUP BY p_brand
  UNION ALL SELECT 'Brand#99', NULL, 0, NULL, 'No Bars')"""


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles: a document each, with tickers, insights, and the same as JSON text."""
    label = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    d = table(spark, sf_dir, "documents").join(label, "doc_id", "left")
    i = F.col("doc_id")
    own = F.concat(F.lit("Brand#"), (1 + i % 25).cast("string"))
    other = F.concat(F.lit("Brand#"), (1 + (i * 7) % 25).cast("string"))
    mood = F.when(i % 17 == 0, "mixed").when(i % 17 == 1, "neutral/positive").when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "neutral")
    tickers = F.when(i % 13 == 0, F.lit(None).cast("array<string>")).when(i % 11 == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.array(own, other)))
    title = F.substring_index("text", "\n", 1)  # the first line; the rest is the description
    d = d.select(
        i.cast("string").alias("article_id"), own.alias("requested_ticker"), title.alias("title"), F.substr("text", F.length(title) + 2).alias("description"),
        F.col("source").alias("publisher_name"), tickers.alias("tickers"), mood.alias("sentiment"),
        F.timestamp_seconds(F.lit(978307200) + (i * 37 % 293) * 86400 + (i % 24) * 3600).alias("published_utc"), i.alias("n"),
    )
    insight = F.transform(F.coalesce("tickers", F.array().cast("array<string>")), lambda t: F.struct(t.alias("ticker"), F.col("sentiment").alias("sentiment"), F.col("title").alias("sentiment_reasoning")))
    d = d.withColumn("insights", F.when(F.col("n") % 5 != 0, insight))
    bad = F.col("n") % 29 == 0
    return d.withColumn("tickers_json", F.when(bad, "{bad").otherwise(F.to_json("tickers"))).withColumn("insights_json", F.when(bad, "{bad").otherwise(F.to_json("insights")))


NEWS = """
news AS (
  SELECT *, CASE WHEN n % 5 <> 0 THEN list_transform(coalesce(tickers, []), lambda t: {'ticker': t, 'sentiment': sentiment, 'sentiment_reasoning': title}) END AS insights
  FROM (
    SELECT CAST(doc_id AS VARCHAR) AS article_id, 'Brand#' || (1 + doc_id % 25) AS requested_ticker, split_part(text, chr(10), 1) AS title, substr(text, length(split_part(text, chr(10), 1)) + 2) AS description,
      source AS publisher_name,
      CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN CAST([] AS VARCHAR[])
        WHEN doc_id % 25 = (doc_id * 7) % 25 THEN ['Brand#' || (1 + doc_id % 25)]
        ELSE ['Brand#' || (1 + doc_id % 25), 'Brand#' || (1 + (doc_id * 7) % 25)] END AS tickers,
      CASE WHEN doc_id % 17 = 0 THEN 'mixed' WHEN doc_id % 17 = 1 THEN 'neutral/positive' WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' WHEN quality = 0 THEN 'neutral' END AS sentiment,
      TIMESTAMP '2001-01-01' + to_days(CAST(doc_id * 37 % 293 AS INTEGER)) + to_hours(CAST(doc_id % 24 AS INTEGER)) AS published_utc, doc_id AS n
    FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)))"""


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, pattern): whole-word alternations to look for in an article."""
    words = ("the|of", "and|thand", "in|inon", "to|ation", "on|eron")
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("ticker")).distinct()
    pick = F.element_at(F.array(*[F.lit(f"(^|[^a-z])({w})([^a-z]|$)") for w in words]), F.pmod(F.substring("ticker", 7, 9).cast("int"), F.lit(len(words))) + 1)
    return part.withColumn("pattern", pick)


PATTERNS = """
patterns AS (
  SELECT ticker, '(^|[^a-z])(' || ['the|of', 'and|thand', 'in|inon', 'to|ation', 'on|eron'][CAST(substr(ticker, 7) AS INTEGER) % 5 + 1] || ')([^a-z]|$)' AS pattern
  FROM (SELECT DISTINCT p_brand AS ticker FROM part))"""


def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, ticker): three tickers a user, two of which may not exist."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    k = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))
    return c.select("user_id", k.alias("k")).select("user_id", F.concat(F.lit("Brand#"), (1 + (F.col("user_id") * F.col("k")) % 27).cast("string")).alias("ticker")).distinct()


WATCHLIST = """
watchlist AS (
  SELECT DISTINCT c_custkey AS user_id, 'Brand#' || (1 + (c_custkey * k) % 27) AS ticker
  FROM customer CROSS JOIN (SELECT unnest([1, 2, 3]) AS k))"""
