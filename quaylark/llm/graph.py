"""Connected components of an edge table, with a few joins a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylark.llm.common import stash


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of `edges(a, b)`; a component's name is its smallest id.

    Rounds of large-star and small-star: first every id's greater neighbours, then its
    smaller ones are tied to the smallest of all. The rounds end when no edge changes; then
    every edge leads to its component. Edges with a null end are ignored; loops and
    repeated edges do no harm. Each round's edges are written to the shared folder.
    """
    own = edges.where("a is not null and b is not null")
    now = stash(own.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(now.select("v", "u"))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stash(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v")).distinct()
