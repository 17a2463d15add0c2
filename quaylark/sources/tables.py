"""Typed sources and sinks: payload shaping, schemas, overwrite, table reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Short names in price payloads.
BAR_NAMES = {"o": "open", "h": "high", "l": "low", "c": "close", "v": "volume", "vw": "vwap", "n": "transactions"}


def parse_time(text: Column) -> Column:
    """ISO text with Z or an offset; null where malformed. Sessions are pinned to UTC."""
    return F.try_to_timestamp(text)


def typed(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """The named columns in order, cast to their types; text that doesn't parse is null, and
    a column that is missing is all null. An empty table stays empty, with the types."""
    out = []
    for name, kind in columns.items():
        col = F.col(name) if name in df.columns else F.lit(None)
        if kind == "timestamp":
            col = parse_time(col.cast("string"))
        elif kind == "date":
            col = F.try_to_date(col.cast("string")) if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(col.cast("string")))
        else:
            col = col.try_cast(kind)
        out.append(col.alias(name))
    return df.select(*out)


def flatten_bars(payload: DataFrame, *, drop_undated: bool = True) -> DataFrame:
    """payload(ticker, t, o, h, l, c, v, vw, n): epoch milliseconds become the UTC date."""
    df = payload.select("ticker", F.to_date(F.timestamp_millis("t")).alias("date"), *[F.col(a).alias(b) for a, b in BAR_NAMES.items()])
    return df.where("date is not null") if drop_undated else df


# The columns of news as loaded.
NEWS_TEXT = ("title", "author", "description", "article_url", "amp_url", "image_url")
PUBLISHER = ("name", "homepage_url", "logo_url", "favicon_url")
NEWS_LISTS = ("tickers", "keywords", "insights")
NEWS = {"article_id": "string", "requested_ticker": "string"} | {c: "string" for c in NEWS_TEXT} | {"published_utc": "timestamp"} | {f"publisher_{c}": "string" for c in PUBLISHER} | {f"{c}_json": "string" for c in NEWS_LISTS} | {"_ingested_at": "timestamp", "_source": "string"}


def flatten_news(payload: DataFrame) -> DataFrame:
    """Lifts publisher fields, keeps lists as JSON text (a missing list is empty); drops rows
    without id or time. Columns and fields that the payload lacks are null."""
    has = lambda c: c in payload.columns
    fields = payload.schema["publisher"].dataType.fieldNames() if has("publisher") else []
    none = F.lit(None).cast("string")
    lists = [F.coalesce(F.to_json(c), F.lit("[]")) if has(c) else F.lit("[]") for c in NEWS_LISTS]
    return payload.select(
        F.col("id").alias("article_id"), "requested_ticker", *[(F.col(c) if has(c) else none).alias(c) for c in NEWS_TEXT], parse_time(F.col("published_utc")).alias("published_utc"),
        *[(F.col(f"publisher.{c}") if c in fields else none).alias(f"publisher_{c}") for c in PUBLISHER], *[x.alias(f"{c}_json") for c, x in zip(NEWS_LISTS, lists)],
    ).where("article_id is not null and published_utc is not null")


# Fields of a company payload, and those of its nested parts.
COMPANY = {
    "ticker": "string", "name": "string", "market": "string", "locale": "string", "primary_exchange": "string", "type": "string", "active": "boolean", "currency_name": "string", "cik": "string",
    "composite_figi": "string", "share_class_figi": "string", "market_cap": "double", "description": "string", "sic_code": "string", "sic_description": "string", "homepage_url": "string",
    "phone_number": "string", "total_employees": "long", "list_date": "date", "ticker_root": "string", "ticker_suffix": "string", "weighted_shares_outstanding": "long",
    "share_class_shares_outstanding": "long", "round_lot": "long",
}
ADDRESS, BRANDING = ("address1", "city", "state", "postal_code"), ("logo_url", "icon_url")
COMPANY_LOADED = COMPANY | {c: "string" for c in ADDRESS + BRANDING} | {"_ingested_at": "timestamp", "_source": "string"}


def flatten_company(payload: DataFrame) -> DataFrame:
    """Lifts address.* and branding.*, types all fields; a part or field that is missing is null."""
    nested = {p: (payload.schema[p].dataType.fieldNames() if p in payload.columns else []) for p in ("address", "branding")}
    lifted = [(F.col(f"{p}.{c}") if c in nested[p] else F.lit(None)).cast("string").alias(c) for p, cs in (("address", ADDRESS), ("branding", BRANDING)) for c in cs]
    own = typed(payload.select("*", *lifted).drop("address", "branding"), COMPANY | {c: "string" for c in ADDRESS + BRANDING})
    return own.withColumn("ticker", F.trim("ticker"))


def overwrite(df: DataFrame, path: str, *, partition_by: list[str] | None = None) -> None:
    """Full refresh, whatever the schema before."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def ensure_table(spark: SparkSession, name: str, ddl: str, *, partition_by: list[str] | None = None, path: str | None = None) -> None:
    """Creates database and Parquet table where they are missing; a second call changes nothing."""
    if "." in name:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name.rsplit('.', 1)[0]}")
    parts = f" PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING parquet{parts}" + (f" LOCATION '{path}'" if path else ""))


def widen(df: DataFrame, name: str) -> None:
    """Adds the columns to the table that df has and it lacks; its own keep their types."""
    spark = df.sparkSession
    held = {c.lower() for c in spark.table(name).columns}
    new = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name.lower() not in held]
    if new:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(new)})")


def overwrite_partitions(df: DataFrame, name: str) -> None:
    """Rewrites the partitions that df has rows of and leaves the others; columns that df lacks
    are null. The files are staged and take the old ones' place when all are written."""
    spark = df.sparkSession
    widen(df, name)
    columns = [F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType) for f in spark.table(name).schema]
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")  # a write into a table takes it from the session only
    try:
        df.select(*columns).write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set(mode, before)


def layout(df: DataFrame) -> DataFrame:
    """Files, bytes and rows of a file-backed table."""
    per = df.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s")).groupBy("f", "s").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("files"), F.sum("s").alias("bytes"), F.sum("n").alias("n_rows"))
