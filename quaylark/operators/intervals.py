"""Closed date intervals: subtraction, merging, backfill plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def subtract(want: DataFrame, have: DataFrame, *, key: str = "ticker") -> DataFrame:
    """What of want(key, event_date, start_date, end_date) isn't in have(key, first, last), which
    has at most one interval a key: the whole, nothing, or what is left and right of it."""
    df = want.join(have, key, "left")
    s, e, a, z = F.col("start_date"), F.col("end_date"), F.col("first"), F.col("last")
    part = lambda x, y: F.struct(x.alias("s"), y.alias("e"))
    apart = a.isNull() | (e < a) | (s > z)
    left = F.when(~apart & (s < a), part(s, F.date_sub(a, 1)))
    right = F.when(~apart & (e > z), part(F.date_add(z, 1), e))
    rest = F.array_compact(F.when(apart, F.array(part(s, e))).otherwise(F.array(left, right)))
    return df.withColumn("r", F.explode(rest)).select(key, "event_date", F.col("r.s").alias("start_date"), F.col("r.e").alias("end_date"))


def merge(df: DataFrame, *, key: str = "ticker", gap_days: int = 1) -> DataFrame:
    """Islands of intervals that overlap or lie up to gap_days apart, with their days and
    different event dates."""
    w = Window.partitionBy(key).orderBy("start_date", "end_date")
    seen = F.max("end_date").over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_new", F.when(seen.isNull() | (F.col("start_date") > F.date_add(seen, gap_days)), 1).otherwise(0))
    df = df.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = df.groupBy(key, "_island").agg(F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"), F.count_distinct("event_date").alias("events"))
    return out.withColumn("days", F.datediff("end_date", "start_date") + 1).drop("_island")


def backfill_plan(events: DataFrame, news: DataFrame, *, days: int = 3) -> DataFrame:
    """Intervals of news to fetch around events(ticker, date), beyond the span of news(ticker,
    published_date) of each ticker."""
    want = events.select("ticker", F.col("date").alias("event_date"), F.date_sub("date", days).alias("start_date"), F.date_add("date", days).alias("end_date"))
    have = news.groupBy("ticker").agg(F.min("published_date").alias("first"), F.max("published_date").alias("last"))
    return merge(subtract(want, have))


def plan_totals(plan: DataFrame) -> DataFrame:
    return plan.groupBy("ticker").agg(F.count(F.lit(1)).alias("intervals"), F.sum("days").alias("days"), F.sum("events").alias("events"), F.min("start_date").alias("first_day"), F.max("end_date").alias("last_day"))
