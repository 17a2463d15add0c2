"""What the training-data operators share: reading, Arrow batch size, shared scratch tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows and bytes in one Arrow batch: texts may be very long, so both are bounded.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
_local: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a local session (tests)
    gets a new folder of this machine; a cluster, whose machines can't share one, an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that the cluster shares")
    global _local
    if _local is None:
        _local = tempfile.mkdtemp(prefix="/tmp/spark-")
    return _local


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, or longer ones where df has a column of that name already."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def col(name: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def cols(df: DataFrame) -> list[Column]:
    return [col(c) for c in df.columns]


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        return


def keep_for_run(spark: SparkSession, path: str) -> str:
    """The path, whose files go when the driver ends."""
    atexit.register(_drop, spark, path)
    return path


def stash(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost
    executors. The files go when the driver ends."""
    spark = df.sparkSession
    path = keep_for_run(spark, f"{shared_folder(spark)}/stash-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def python_map(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], out: str, keep: list[str], use: list[str] | None = None) -> DataFrame:
    """Columns `keep` as they are (null ids stay integers) and those of `out`, which the
    function that `make` returns computes from a batch's columns `use` (the others, unless
    given). Nothing is shuffled.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    given = use if use is not None else [c for c in df.columns if c not in keep]
    new = StructType.fromDDL(out)
    schema = StructType([df.schema[c] for c in keep] + new.fields)
    names, at = [f.name for f in new.fields], {c: i for i, c in enumerate(df.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        fn, kinds = make(), [to_arrow_type(f.dataType) for f in new.fields]
        for b in batches:
            got = fn({c: b.column(at[c]).to_pylist() for c in given})
            arrays = [b.column(at[c]) for c in keep] + [pa.array(got[n], k) for n, k in zip(names, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *names])

    # By place, as names may have dots.
    return df.toDF(*(f"c{i}" for i in range(len(at)))).mapInArrow(run, schema)


def with_set(df: DataFrame, sets: DataFrame, key: Column, value: str, *, bound_bytes: int = 16 << 20, salts: int = 64) -> DataFrame:
    """df and the column `value` of `sets(key, value)`: one row a key with an array.

    Keys may be null (they match null) and very uneven: where the arrays take at most
    `bound_bytes` altogether the sets are broadcast, else the rows of a key are dealt over
    `salts` parts and the sets are repeated for each. df must have no column `value`.
    """
    k, part, salt = fresh(df, "set_key", "set_part", "set_salt")
    right = sets.toDF(k, value)
    size = right.agg(F.sum(F.size(value) * 8 + 64)).first()[0] or 0
    if size <= bound_bytes:
        return df.join(F.broadcast(right), key.eqNullSafe(F.col(k)), "left").drop(k)
    right = right.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = df.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    return left.join(right, key.eqNullSafe(F.col(k)) & (F.col(salt) == F.col(part)), "left").drop(k, part, salt)


#: Ids of 64 bits that are broadcast at most: some 100 MB on each executor.
BROADCAST_IDS = 2_000_000


def filter_ids(df: DataFrame, key: str, ids: DataFrame, *, keep: bool) -> DataFrame:
    """The rows of df whose `key` is in the one column of ids, or with keep=False those whose
    isn't. Up to BROADCAST_IDS ids are broadcast, so that df's rows stay where they are;
    beyond that both sides are shuffled. `ids` is counted first and should be a stored table."""
    name = fresh(df, "own_id")[0]
    own = ids.toDF(name)
    own = F.broadcast(own) if own.count() <= BROADCAST_IDS else own
    return df.join(own, col(key) == F.col(name), "left_semi" if keep else "left_anti")
