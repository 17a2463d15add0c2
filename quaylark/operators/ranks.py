"""Ranks over all rows of a table, without a window that has all of them.

Rows are dealt to ranges of the order, which are sorted each on its own; the sizes of the
ranges, added up, are the offsets of the ranks inside. A range has about `range_rows` rows at
any size of the table. Equal values are one row with a count before they are dealt, so that
a value which many rows share is no large range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylark.sources.shared import stored

RANGE_ROWS = 1_000_000


def _ranges(n: int, range_rows: int) -> int:
    return max(1, -(-n // range_rows))


def _offsets(sizes: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """sizes(range, *group, n) with `before`, the rows of the ranges ahead: one row a range."""
    ahead = Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(sizes.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n"))


def row_numbers(df: DataFrame, order: Sequence[Column], name: str, *, range_rows: int = RANGE_ROWS) -> DataFrame:
    """df with the column `name`: 1, 2, ... in the order of all rows. The order's columns should
    tell any two rows apart; rows that it doesn't are numbered in some order."""
    first = stored(df, "rows")
    n = _ranges(first.count(), range_rows)
    # Inside a partition the low bits of this id count the rows in their sorted order.
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    dealt = first.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumns({"range": F.spark_partition_id(), "place": place})
    dealt = stored(dealt, "ranges")
    sizes = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    return dealt.join(_offsets(sizes), "range").withColumn(name, (F.col("before") + F.col("place") + 1).cast("int")).select(*df.columns, name)


def percent_ranks(df: DataFrame, columns: Mapping[str, tuple[str, bool]], *, range_rows: int = RANGE_ROWS) -> DataFrame:
    """df with a column for each of `columns`, output -> (value column, ascending): 100 times the
    rows of a smaller value (larger, if descending) by the other rows, over all rows that have a
    value. Null and NaN have none and get null; one value alone gets 0; equal values share
    the lowest rank. Every row stays, equal rows and null keys too."""
    own = stored(df.withColumn("_row", F.monotonically_increasing_id()), "ranked")
    value = lambda c, up: F.col(c).cast("double") * (1 if up else -1)
    pairs = F.array(*[F.struct(F.lit(out).alias("out"), F.when(~F.isnan(F.col(c).cast("double")), value(c, up) + 0.0).alias("v")) for out, (c, up) in columns.items()])
    long = own.select("_row", F.explode(pairs).alias("p")).select("_row", "p.out", "p.v").where("v is not null")
    values = stored(long.groupBy("out", "v").agg(F.count(F.lit(1)).alias("n")), "values")
    parts = _ranges(values.count(), range_rows)
    dealt = stored(values.repartitionByRange(parts, "out", "v").withColumn("range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("range", "out").agg(F.sum("n").alias("n"))
    smaller = Window.partitionBy("range", "out").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    totals = F.broadcast(sizes.groupBy("out").agg(F.sum("n").alias("total")))
    rank = F.col("before") + F.coalesce(F.sum("n").over(smaller), F.lit(0))
    ranked = dealt.join(_offsets(sizes, ["out"]), ["range", "out"]).withColumn("rank", rank).join(totals, "out")
    ranked = ranked.select("out", "v", F.when(F.col("total") > 1, 100.0 * (F.col("rank") / (F.col("total") - 1))).otherwise(0.0).alias("score"))
    wide = long.join(ranked, ["out", "v"]).groupBy("_row").agg(*[F.max(F.when(F.col("out") == out, F.col("score"))).alias(out) for out in columns])
    return own.join(wide, "_row", "left").select(*df.columns, *columns)
