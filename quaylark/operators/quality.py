"""Data-quality rules as tables: (rule, violations, passed), each from one aggregate."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylark.functions.columns import flag


def _named(name: str, df: DataFrame, column: str = "violations") -> DataFrame:
    return df.select(F.lit(name).alias("rule"), F.col(column).cast("long").alias("violations"))


def row_rules(df: DataFrame, bad: Mapping[str, Column]) -> DataFrame:
    """Rules on single rows: the condition says which rows break one; unknown breaks none.
    All of them are counted in one pass, and unpivoted."""
    counts = df.agg(*[F.count_if(flag(c)).alias(f"r{i}") for i, c in enumerate(bad.values())])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("violations")) for i, n in enumerate(bad)]))
    return counts.select(pairs.alias("x")).select("x.rule", "x.violations")


def non_empty(name: str, df: DataFrame) -> DataFrame:
    return _named(name, df.agg((F.count(F.lit(1)) == 0).cast("long").alias("violations")))


def unique(name: str, df: DataFrame, keys: list[str]) -> DataFrame:
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return _named(name, n.agg(F.count_if(F.col("_n") > 1).alias("violations")))


def refers(name: str, df: DataFrame, to: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a counterpart."""
    return _named(name, df.join(to.select(*keys).distinct(), keys, "left_anti").agg(F.count(F.lit(1)).alias("violations")))


def same_keys(name: str, a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one of two tables has."""
    x, y = a.select(*keys).distinct().withColumn("_a", F.lit(1)), b.select(*keys).distinct().withColumn("_b", F.lit(1))
    return _named(name, x.join(y, keys, "full").agg(F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("violations")))


def ranked(name: str, df: DataFrame, rank: str, group: list[str]) -> DataFrame:
    """Groups whose rank isn't 1 to n without repeats."""
    g = df.groupBy(*group) if group else df.groupBy()
    per = g.agg(F.min(rank).alias("_lo"), F.max(rank).alias("_hi"), F.count_distinct(rank).alias("_d"), F.count(rank).alias("_n"))
    return _named(name, per.agg(F.count_if((F.col("_n") > 0) & ((F.col("_lo") != 1) | (F.col("_hi") != F.col("_n")) | (F.col("_d") != F.col("_n")))).alias("violations")))


def rate(name: str, df: DataFrame, hit: Column, low: float, high: float) -> DataFrame:
    """The share of rows, in percent, must lie from low to high; an empty table has none."""
    share = 100.0 * F.count_if(flag(hit)) / F.when(F.count(F.lit(1)) > 0, F.count(F.lit(1)))
    return _named(name, df.agg(F.coalesce((~share.between(low, high)).cast("long"), F.lit(0)).alias("violations")))


def verdict(spark: SparkSession, rules: list[DataFrame]) -> DataFrame:
    """All rules and, as the last one, ALL: the number of rules that failed."""
    rows = reduce(DataFrame.unionByName, rules).withColumn("passed", F.col("violations") == 0)
    total = rows.agg(F.lit("ALL").alias("rule"), F.count_if(~F.col("passed")).alias("violations")).withColumn("passed", F.col("violations") == 0)
    return rows.unionByName(total)


def correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Pearson's r of column pairs in one pass, over rows where both are known."""
    out = df.agg(*[F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.round(F.col(f"c{i}"), 9), 6).alias("r")) for i, (a, b) in enumerate(pairs)]))
    return out.select(rows.alias("x")).select("x.*")


def distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n) of several columns in one aggregate."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(pairs.alias("x")).groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("n"))


def parts_add_up(df: DataFrame, totals: Mapping[str, tuple[str, list[str]]]) -> DataFrame:
    """Rules name -> (total, parts): rows whose parts, unknown ones as 0, don't add up to it."""
    return row_rules(df, {name: sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0)) != F.coalesce(total, F.lit(0)) for name, (total, parts) in totals.items()})


def within(measures: DataFrame, limits: DataFrame) -> DataFrame:
    """measures(rule, value) against limits(rule, low, high): each limit with its value and whether
    it holds. An open end is null; a value that is unknown or wasn't measured fails."""
    value = F.round(F.round("value", 9), 4)
    held = (F.col("low").isNull() | (F.col("value") >= F.col("low"))) & (F.col("high").isNull() | (F.col("value") <= F.col("high")))
    return limits.join(measures, "rule", "left").select("rule", value.alias("value"), "low", "high", flag(held & F.col("value").isNotNull()).alias("passed"))
