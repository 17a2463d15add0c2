"""US market calendar as a table, and how fresh tables are against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaylark.functions.columns import flag


def _nth(d: Column, month: int, weekday: int, n: int) -> Column:
    """Whether d is the n-th weekday (1 is Sunday) of the month; n = -1 is the last."""
    in_month = (F.month(d) == month) & (F.dayofweek(d) == weekday)
    if n > 0:
        return in_month & (F.ceil(F.dayofmonth(d) / 7) == n)
    return in_month & (F.month(F.date_add(d, 7)) != month)


def _observed(d: Column, month: int, day: int) -> Column:
    """A fixed day, kept on Friday if it is a Saturday and on Monday if it is a Sunday."""
    on = lambda x: (F.month(x) == month) & (F.dayofmonth(x) == day)
    week = F.dayofweek(d)
    return (on(d) & week.between(2, 6)) | ((week == 6) & on(F.date_add(d, 1))) | ((week == 2) & on(F.date_sub(d, 1)))


def easter(year: Column) -> Column:
    """Easter Sunday of a Gregorian year, by the epact and the following Sunday."""
    golden = year % 19
    century = F.floor(year / 100)
    moon = (19 * golden + century - F.floor(century / 4) - F.floor((8 * century + 13) / 25) + 15) % 30
    moon = moon - F.when((moon == 29) | ((moon == 28) & (golden > 10)), 1).otherwise(0)
    full = F.date_add(F.make_date(year.cast("int"), F.lit(3), F.lit(21)), moon.cast("int"))
    return F.date_add(full, 8 - F.dayofweek(full))


def trading_calendar(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(date, is_open, holiday, last_open): a row a day; last_open is the last open day on or
    before it. Days are few whatever the data, so one task orders them."""
    d = F.col("date")
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date"))
    rules = {
        "New Year's Day": _observed(d, 1, 1), "Martin Luther King Jr. Day": _nth(d, 1, 2, 3), "Washington's Birthday": _nth(d, 2, 2, 3), "Good Friday": d == F.date_sub(easter(F.year(d)), 2),
        "Memorial Day": _nth(d, 5, 2, -1), "Juneteenth": _observed(d, 6, 19) & (F.year(d) >= 2022), "Independence Day": _observed(d, 7, 4), "Labor Day": _nth(d, 9, 2, 1), "Thanksgiving": _nth(d, 11, 5, 4), "Christmas": _observed(d, 12, 25),
    }
    name = F.coalesce(*[F.when(c, n) for n, c in rules.items()])
    days = days.withColumn("holiday", name).withColumn("is_open", F.dayofweek(d).between(2, 6) & F.col("holiday").isNull())
    return days.withColumn("last_open", F.last(F.when(F.col("is_open"), d), ignorenulls=True).over(Window.orderBy("date")))


def freshness(prices: DataFrame, news: DataFrame, keys: DataFrame, calendar: DataFrame, now: str, *, max_age_hours: int = 30) -> DataFrame:
    """(data_type, ticker, status, last_value, lag_days) at the time `now`: prices are due on the
    last open day before today, news must have been loaded within max_age_hours; one row
    (system, ALL) sums up. prices(ticker, date), news(ticker, loaded_at)."""
    clock = F.lit(now).cast("timestamp")
    today = F.to_date(clock)
    due = calendar.where(F.col("date") == F.date_sub(today, 1)).select(F.col("last_open").alias("due"))
    p = keys.join(prices.groupBy("ticker").agg(F.max("date").alias("at")), "ticker", "left").crossJoin(F.broadcast(due))
    p = p.select(F.lit("prices").alias("data_type"), "ticker", F.when(F.col("at").isNull(), "ERROR").when(F.col("at") >= F.col("due"), "FRESH").otherwise("STALE").alias("status"), F.col("at").cast("string").alias("last_value"), F.greatest(F.datediff("due", "at"), F.lit(0)).alias("lag_days"))
    n = keys.join(news.groupBy("ticker").agg(F.max("loaded_at").alias("at")), "ticker", "left")
    hours = F.timestamp_diff("SECOND", F.col("at"), clock) / 3600
    n = n.select(F.lit("news").alias("data_type"), "ticker", F.when(F.col("at").isNull(), "ERROR").when(flag(hours <= max_age_hours), "FRESH").otherwise("STALE").alias("status"), F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("last_value"), F.greatest(F.datediff(today, F.to_date("at")), F.lit(0)).alias("lag_days"))
    both = p.unionByName(n)
    worst = F.max(F.when(F.col("status") == "ERROR", 2).when(F.col("status") == "STALE", 1).otherwise(0))
    total = both.agg(worst.alias("w"), F.concat_ws(" ", *[F.concat(F.lit(f"{s.lower()}="), F.count_if(F.col("status") == s).cast("string")) for s in ("FRESH", "STALE", "ERROR")]).alias("last_value"), F.max("lag_days").alias("lag_days"))
    total = total.select(F.lit("system").alias("data_type"), F.lit("ALL").alias("ticker"), F.when(F.col("w") == 2, "ERROR").when(F.col("w") == 1, "STALE").otherwise("FRESH").alias("status"), "last_value", "lag_days")
    return both.unionByName(total)


def freshness_report(rows: DataFrame) -> DataFrame:
    """Per data type, in the order system, prices, news: keys of each status and largest lag."""
    place = F.when(F.col("data_type") == "system", 0).when(F.col("data_type") == "prices", 1).otherwise(2)
    return rows.groupBy("data_type").agg(F.min(place).alias("place"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("FRESH", "STALE", "ERROR")], F.max("lag_days").alias("max_lag_days")).orderBy("place")
