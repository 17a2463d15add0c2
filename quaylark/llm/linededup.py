"""Boilerplate lines by their frequency inside a site.

Per host, the pages that contain a line are divided by the host's pages; lines above a
ratio are boilerplate of that host and go from all of its pages. Pages of equal text count as
one page, so that copying a text doesn't make its lines boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaylark.llm.common import col, cols, fresh, stash, with_set

#: Least share and number of a host's pages.
RATIO, MIN_PAGES = 0.05, 5


def _keys(text: Column) -> Column:
    """Hash of each line without the spaces around it; null for blank lines."""
    return F.transform(F.split(text, "\n"), lambda x: F.when(F.trim(x) != "", F.xxhash64(F.trim(x))))


def boilerplate(docs: DataFrame, *, host_col: str, text_col: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, lines): hashes of lines on at least `ratio` of a host's different pages and on
    at least `min_pages` of them.

    Pages are made different, and lines counted, with partial aggregates ahead of each
    shuffle, so a very large host is spread over its texts and lines. A host has at most
    1 / ratio times the lines of its average page.
    """
    pages = docs.where(col(text_col).isNotNull()).select(col(host_col).alias("host"), col(text_col).alias("t"))
    pages = pages.select("host", F.xxhash64("t").alias("page"), F.array_distinct(F.filter(_keys(F.col("t")), lambda x: x.isNotNull())).alias("k"))
    # A page itself travels as the line null: one pass counts both.
    held = pages.select("host", "page", F.explode(F.concat(F.array(F.lit(None).cast("long")), "k")).alias("line")).distinct()
    # Both are read below: stored, as the texts would be read and cut once for each.
    counts = stash(held.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("line").isNull() | (F.col("n") >= min_pages)))
    totals = counts.where("line is null").select(F.col("host").alias("h"), F.col("n").alias("total"))
    often = counts.where("line is not null")
    return often.join(totals, F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") >= ratio * F.col("total")).groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(docs: DataFrame, *, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: tuple[str, str] | None = None) -> DataFrame:
    """docs with boilerplate lines taken out of `text_col`; with `counts`, two more columns
    of these names: a row's lines, and those of them that were dropped.

    Every row stays. A null text stays null and has no lines; an empty one has one blank
    line, and blank lines stay. Rows without host share one group. Repeated rows all stay.
    Other columns are untouched, whatever their names; an empty table stays empty.
    """
    lines = stash(boilerplate(docs, host_col=host_col, text_col=text_col, ratio=ratio, min_pages=min_pages))
    sets, kept, n_lines, n_dropped = fresh(docs, "line_set", "line_kept", "line_n", "line_n_dropped")
    held = with_set(docs, lines, col(host_col), sets)
    text = col(text_col)
    # The intersection goes through a hash set; what is left to search has a page's own lines.
    hits = F.array_intersect(_keys(text), col(sets))
    parts = F.arrays_zip(F.split(text, "\n").alias("x"), _keys(text).alias("k"))
    held = held.withColumn(sets, F.when(F.size(hits) > 0, hits))
    left = F.filter(parts, lambda p: F.coalesce(~F.array_contains(col(sets), p["k"]), F.lit(True)))
    held = held.withColumn(kept, F.when(col(sets).isNotNull(), F.transform(left, lambda p: p["x"])))
    n = F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).cast("long")
    held = held.withColumn(n_lines, n).withColumn(n_dropped, F.coalesce(col(n_lines) - F.size(kept), F.lit(0)).cast("long"))
    new = F.when(col(n_dropped) > 0, F.concat_ws("\n", kept)).otherwise(text)
    own = [new.alias(c) if c == text_col else col(c) for c in docs.columns]
    return held.select(*own, *([col(n_lines).alias(counts[0]), col(n_dropped).alias(counts[1])] if counts else []))


def line_report(docs: DataFrame, *, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """id, n_lines, n_dropped and the text left of every row of docs.

    Nulls, empty texts, repeated rows and empty tables as in `drop_boilerplate`; columns
    other than the three named are ignored.
    """
    rows = docs.select(col(id_col).alias("i"), col(host_col).alias("h"), col(text_col).alias("text"))
    out = drop_boilerplate(rows, host_col="h", text_col="text", counts=("n_lines", "n_dropped"), **options)
    return out.select(F.col("i").alias(id_col), "n_lines", "n_dropped", "text")


#: DuckDB twin of the report with its default settings.
ORACLE = rf"""
WITH page AS (SELECT DISTINCT source, text FROM documents WHERE text IS NOT NULL),
held AS (SELECT DISTINCT source, text AS page, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM page),
total AS (SELECT source, count(*) AS total FROM page GROUP BY source),
often AS (
  SELECT held.source, line FROM held JOIN total ON held.source IS NOT DISTINCT FROM total.source
  WHERE line <> '' GROUP BY held.source, line, total HAVING count(*) >= {MIN_PAGES} AND count(*) >= {RATIO} * total),
sets AS (SELECT source, list(line) AS lines FROM often GROUP BY source),
cut AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS all_lines,
    list_filter(string_split(text, chr(10)), lambda x: NOT coalesce(list_contains(lines, trim(x, ' ')), false)) AS kept
  FROM documents LEFT JOIN sets ON documents.source IS NOT DISTINCT FROM sets.source)
SELECT doc_id, CAST(coalesce(len(all_lines), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(all_lines) - len(kept), 0) AS BIGINT) AS n_dropped,
  CASE WHEN text IS NULL THEN NULL WHEN len(kept) = len(all_lines) THEN text ELSE array_to_string(kept, chr(10)) END AS text
FROM cut
"""
