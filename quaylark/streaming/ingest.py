"""Events from a folder of files, cleaned and put into a table newer-wins, batch by batch.

The table is a log: every batch adds its own newest row of each key, and nothing else is
written. The state is the newest row of each key over the log; as the newest of newest rows is
the newest, it doesn't matter in which order or how often rows were added. Now and then the
log up to a batch is folded into one part, which readers take instead of those batches.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Batches after which the log is folded.
FOLD_EVERY = 64
#: What tells the newer of two rows.
VERSION = ("ts", "event_id")


def read_events(spark: SparkSession, folder: str, schema, *, files_per_batch: int = 8) -> DataFrame:
    """The stream of events that have an id and a time. Files may come in any order of event
    time, as in a replay of history: no watermark decides, and repeats go in the upsert."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return raw.where("event_id is not null and ts is not null").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.from_json("props", "k INT")["k"])


def _newest(rows: DataFrame, keys: list[str], version: tuple[str, ...]) -> DataFrame:
    """One row a key: of the highest version; of equal ones that of the earlier batch, then
    by the row's own values, so that the order of arrival decides nothing."""
    own = F.struct(*rows.columns)
    order = F.struct(*version, -F.col("_batch"), F.xxhash64(*[c for c in rows.columns if c != "_batch"]))
    return rows.groupBy(*keys).agg(F.max_by(own, order).alias("r")).select("r.*")


def _log(spark: SparkSession, table: str, upto: int | None = None) -> DataFrame | None:
    """The rows of the newest fold and of the batches after it; None where there are none."""
    def part(name: str, column: str) -> DataFrame | None:
        try:
            df = spark.read.parquet(f"{table}/{name}")
        except AnalysisException:  # not written yet
            return None
        return df if upto is None else df.where(F.col(column) <= upto)

    folds, deltas = part("folds", "upto"), part("batches", "batch")
    last = folds.agg(F.max("upto")).first()[0] if folds is not None else None
    if last is None:
        return None if deltas is None else deltas.withColumnRenamed("batch", "_batch")
    held = folds.where(F.col("upto") == last).drop("upto")
    if deltas is None:
        return held
    # Folders of other batches aren't read.
    return held.unionByName(deltas.where(F.col("batch") > last).withColumnRenamed("batch", "_batch"))


def add_batch(df: DataFrame, table: str, n: int, keys: list[str], *, version: tuple[str, ...] = VERSION) -> None:
    """Batch n of the log; written again, it is the same."""
    _newest(df.withColumn("_batch", F.lit(n)), keys, version).drop("_batch").write.mode("overwrite").parquet(f"{table}/batches/batch={n}")


def fold(spark: SparkSession, table: str, upto: int, keys: list[str], *, version: tuple[str, ...] = VERSION) -> None:
    """The state after batch `upto` as one part of the log. What it replaces stays for readers
    that have begun."""
    log = _log(spark, table, upto)
    if log is not None:
        _newest(log, keys, version).write.mode("overwrite").parquet(f"{table}/folds/upto={upto}")


def upsert_stream(events: DataFrame, table: str, checkpoint: str, keys: list[str], *, version: tuple[str, ...] = VERSION, fold_every: int = FOLD_EVERY) -> StreamingQuery:
    """Runs what is there and stops. A batch that runs twice changes nothing."""

    def batch(df: DataFrame, n: int) -> None:
        add_batch(df, table, n, keys, version=version)
        if (n + 1) % fold_every == 0:
            fold(df.sparkSession, table, n, keys, version=version)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_state(spark: SparkSession, table: str, keys: list[str], *, version: tuple[str, ...] = VERSION) -> DataFrame:
    """The table as its newest batch left it."""
    log = _log(spark, table)
    if log is None:
        raise ValueError(f"no batch was written to {table}")
    return _newest(log, keys, version).drop("_batch")
