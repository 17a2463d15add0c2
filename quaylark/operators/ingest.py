"""Upserts and incremental loads as pure functions: (target, source) -> new target."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_in_batch(batch: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """One row a key: the one that arrived last."""
    row = F.max_by(F.struct(*[F.col(c) for c in batch.columns]), arrival)
    return batch.groupBy(*keys).agg(row.alias("_r")).select("_r.*")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], *, mode: str = "last", version: str = "_ingested_at") -> DataFrame:
    """The new target. mode: last - the source's row wins; newer - it wins only if its
    version is above the stored one (an equal or unknown stored version stays); insert -
    only new keys. The source has one row a key; applying it twice changes nothing more."""
    cols = target.columns
    source = source.select(*cols)
    if mode == "last":
        return target.join(source.select(*keys), keys, "left_anti").select(*cols).unionByName(source)
    if mode == "insert":
        return target.unionByName(source.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti").select(*cols))
    if mode != "newer":
        raise ValueError(f"unknown mode {mode}")
    both = target.withColumn("_stored", F.lit(1)).unionByName(source.withColumn("_stored", F.lit(0)))
    held = (F.col("_stored") == 1) & F.col(version).isNull()
    order = Window.partitionBy(*keys).orderBy(held.desc(), F.col(version).desc_nulls_last(), F.col("_stored").desc())
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(*cols)


def high_water(table: DataFrame, key: str, ts: str) -> DataFrame:
    return table.groupBy(key).agg(F.max(ts).alias("high_water"))


def fetch_plan(table: DataFrame, keys: DataFrame, as_of: str, *, key: str = "ticker", ts: str = "date", overlap_days: int = 0, lag_days: int = 1, first_days: int = 729) -> DataFrame:
    """(key, high_water, fetch_from, fetch_to, outcome) for every key: from the day after the
    last one loaded (or `overlap_days` before it) up to as_of - lag."""
    end = F.date_sub(F.lit(as_of).cast("date"), lag_days)
    df = keys.select(key).distinct().join(high_water(table, key, ts), key, "left")
    mark = F.col("high_water").cast("date")
    start = F.when(mark.isNull(), F.date_sub(end, first_days)).otherwise(F.date_sub(mark, overlap_days) if overlap_days else F.date_add(mark, 1))
    df = df.withColumns({"fetch_from": start, "fetch_to": end})
    return df.withColumn("outcome", F.when(F.col("fetch_from") > F.col("fetch_to"), "UP_TO_DATE").when(mark.isNull(), "FIRST_LOAD").otherwise("FETCH"))


def outcomes(before: DataFrame, after: DataFrame, *, key: str = "ticker", ts: str = "date") -> DataFrame:
    """What a load did to each key."""
    one = lambda df, p: df.groupBy(key).agg(F.count(F.lit(1)).alias(f"{p}_rows"), F.max(ts).alias(f"{p}_max"))
    df = one(before, "before").join(one(after, "after"), key, "full").fillna(0, subset=["before_rows", "after_rows"])
    new = F.col("after_rows") - F.col("before_rows")
    return df.withColumns({"new_rows": new, "outcome": F.when(F.col("after_rows") == 0, "NO_DATA").when(F.col("after_max") > F.col("before_max"), "UPDATED").when(F.col("before_rows") == 0, "UPDATED").when(new > 0, "REFRESHED").otherwise("NO_NEW_DATA")})


def load_audit(table: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """One row: rows, time span, distinct and duplicate keys, nulls of each key column."""
    per = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    nulls = [F.sum(F.when(F.col(k).isNull(), F.col("_n")).otherwise(0)).alias(f"null_{k}") for k in keys]
    return per.agg(F.sum("_n").alias("n_rows"), F.min("_lo").alias("first"), F.max("_hi").alias("last"), F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("_n") > 1).alias("duplicate_keys"), *nulls)


def null_audit(table: DataFrame) -> DataFrame:
    """(name, nulls, n_rows) of every column, from one pass."""
    counts = table.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"c{i}") for i, c in enumerate(table.columns)])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"c{i}").alias("nulls")) for i, c in enumerate(table.columns)]))
    return counts.select(pairs.alias("x"), "n").select("x.name", "x.nulls", F.col("n").alias("n_rows"))


def newest(table: DataFrame, ts: str, keys: list[str], *, n: int = 20) -> DataFrame:
    """The n newest rows with their `place`; each task keeps no more than n of its own. Rows of
    equal time are in the order of their keys."""
    order = [F.col(ts).desc_nulls_last(), *keys]
    return table.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # n rows
