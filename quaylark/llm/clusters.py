"""Clusters of vectors around centroids, over a vector-approximation file.

A vector's approximation is the number of its cell in each dimension, a few bits each; cells
are cut at quantiles of all vectors. For a cell and a centroid's component the least and the
greatest difference are known, so that tables of their squares, looked up and added over
the dimensions, give an interval for the distance to each centroid. A centroid whose
interval begins beyond the end of another's can't be the nearest. Where one is left, it is the
nearest; where intervals overlap, the full vector is taken out and its exact distance to
those that are left decides.

Approximation and vector lie in one row of a stored table, both packed as bytes: a join that
fetched single vectors from another table would read that table whole. Each round is one pass
without a shuffle of vectors; what leaves a task is a sum for each centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylark.llm.common import col, stash

#: Components of a vector, what they are multiplied with, centroids, rounds.
DIMS, SCALE, CENTROIDS, ROUNDS = 64, 256, 40, 5
#: Bits of a cell. Quantiles are found with this accuracy, of which results don't depend.
BITS, ACCURACY = 6, 2000
#: Components up to this size: all distances of 64 of them fit into 63 bits.
LARGEST = 1 << 27
#: Rows in one Arrow batch.
ROWS = 4096


def whole_vectors(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(id, v) of the rows whose vector has `dims` components, all of them finite: each one is
    the integer floor(scale * x). One beyond LARGEST is an error."""
    # A change of scale by a power of two and the floor of a double are exact.
    x = F.transform(col(vector_col), lambda e: e.cast("double"))
    good = (F.size(x) == dims) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    own = table.select(col(id_col).alias("id"), F.when(good, x).alias("x")).where("x is not null")
    fits = lambda e: F.when(F.abs(e) > LARGEST, F.raise_error(F.lit("a vector's component is too large for exact distances"))).otherwise(e)
    return own.select("id", F.transform("x", lambda e: fits(F.floor(e * scale)).cast("int")).alias("v"))


@dataclass
class Grid:
    """Cells of each dimension: cell c holds the values from low[c] to high[c]."""

    low: list[np.ndarray]
    high: list[np.ndarray]

    def cells(self, v: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(low[1:], v[:, d], side="right") for d, low in enumerate(self.low)], axis=1).astype(np.uint8)

    def tables(self, centroids: np.ndarray) -> np.ndarray:
        """[dimension, cell, bound, centroid]: squares of the least and the greatest difference."""
        out = np.zeros((len(self.low), max(map(len, self.low)), 2, len(centroids)), np.int64)
        for d, (low, high) in enumerate(zip(self.low, self.high)):
            c, a, b = centroids[:, d][None], low[:, None], high[:, None]
            out[d, : len(low), 0] = np.maximum(0, np.maximum(a - c, c - b)) ** 2
            out[d, : len(low), 1] = np.maximum(np.abs(c - a), np.abs(c - b)) ** 2
        return out


def fit_grid(vectors: DataFrame, bits: int = BITS, dims: int = DIMS) -> Grid | None:
    """Cells at quantiles of all vectors(v); None without any. The driver gets a few numbers
    for each dimension."""
    marks = [i / (1 << bits) for i in range(1, 1 << bits)]
    got = vectors.agg(*(f(F.col("v")[d]) for d in range(dims) for f in (F.min, F.max, lambda x: F.percentile_approx(x, marks, ACCURACY)))).first()
    if got is None or got[0] is None:
        return None
    low, high = [], []
    for d in range(dims):
        least, most, inner = got[3 * d : 3 * d + 3]
        cuts = np.unique(np.array([x for x in inner if x > least], np.int64))
        low.append(np.concatenate([[least], cuts]).astype(np.int64))
        high.append(np.concatenate([cuts - 1, [most]]).astype(np.int64))
    return Grid(low, high)


def _column(b: pa.RecordBatch, i: int, kind: type, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(b.column(i).to_pylist()), kind).reshape(-1, dims)


def _packed(rows: np.ndarray, kind: str) -> list[bytes]:
    data, width = np.ascontiguousarray(rows.astype(kind)).tobytes(), rows.shape[1] * np.dtype(kind).itemsize
    return [data[i : i + width] for i in range(0, len(data), width)]


def _encode(grid: Grid, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1).flatten().to_numpy().reshape(-1, dims)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_packed(grid.cells(v), "u1"), pa.binary()), pa.array(_packed(v, "<i4"), pa.binary())], names=["id", "cells", "vector"])

    return run


class Nearest:
    """Nearest centroid of each vector by intervals, then by exact distance."""

    def __init__(self, grid: Grid, centroids: np.ndarray):
        self.centroids, self.tables = centroids, grid.tables(centroids)

    def intervals(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros((len(cells), 2, len(self.centroids)), np.int64)
        for d, table in enumerate(self.tables):
            out += table[cells[:, d]]
        return out[:, 0], out[:, 1]

    def distances(self, v: np.ndarray, centroid: np.ndarray) -> np.ndarray:
        return ((v.astype(np.int64) - self.centroids[centroid]) ** 2).sum(axis=1)

    def __call__(self, cells: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, int]:
        """Numbers of the centroids, and how many vectors were taken out to find them."""
        low, high = self.intervals(cells)
        left = low <= high.min(axis=1, keepdims=True)
        best, open_ = left.argmax(axis=1), np.flatnonzero(left.sum(axis=1) > 1)
        row, c = np.nonzero(left[open_])
        exact = np.full((len(open_), len(self.centroids)), np.iinfo(np.int64).max)
        exact[row, c] = self.distances(vectors[open_[row]], c)
        best[open_] = exact.argmin(axis=1)  # the first of equal ones
        return best, len(open_)


def _sums(nearest: Nearest, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(nearest.centroids)
        total, count, taken = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), 0
        for b in batches:
            vectors = _column(b, 2, np.int32, dims)
            best, n = nearest(_column(b, 1, np.uint8, dims), vectors)
            order = np.argsort(best, kind="stable")
            own, first = np.unique(best[order], return_index=True)
            if len(own):
                total[own] += np.add.reduceat(vectors[order].astype(np.int64), first, axis=0)
            count += np.bincount(best, minlength=k)
            taken += n
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.int64())), pa.array([taken] + [0] * (len(some) - 1) if len(some) else [], pa.int64())],
            names=["cluster", "n", "total", "taken"])

    return run


def _assigned(nearest: Nearest, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = _column(b, 2, np.int32, dims)
            best, _ = nearest(_column(b, 1, np.uint8, dims), vectors)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best.astype(np.int32)), pa.array(nearest.distances(vectors, best))], names=["id", "cluster", "distance"])

    return run


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: int = 2) -> list[list[int]]:
    """The k vectors(id, v) with the smallest SHA-256 of `seed:id`, in that order; those without
    id come last, vectors of equal id by their components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return [r["v"] for r in vectors.select(order.alias("o"), "v").orderBy(F.asc_nulls_last("o"), "v").limit(k).collect()]


def cluster(vectors: DataFrame, *, k: int = CENTROIDS, rounds: int = ROUNDS, bits: int = BITS, dims: int = DIMS, seed: int = 2) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(id, cluster, distance) of vectors(id, v), the centroids, and the vectors that each round
    took out. Every round assigns each vector to the nearest centroid (of equally near ones
    the smaller number) and moves each centroid that has any to the floor of their mean."""
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)
    grid = fit_grid(vectors, bits, dims)
    kind = vectors.schema["id"].dataType.simpleString()
    if grid is None:
        return spark.createDataFrame([], f"id {kind}, cluster int, distance long"), np.zeros((0, dims), np.int64), []
    centroids = np.array(first_centroids(vectors, k, seed), np.int64)
    file, taken = stash(vectors.mapInArrow(_encode(grid, dims), f"id {kind}, cells binary, vector binary")), []
    for _ in range(rounds):
        sums = file.mapInArrow(_sums(Nearest(grid, centroids), dims), "cluster int, n long, total array<long>, taken long")
        part = sums.select("cluster", F.posexplode("total").alias("at", "x"), "n", "taken")
        # k x dims rows reach the driver, which divides integers of any size.
        got = part.groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n"), F.sum("taken").alias("taken")).collect()
        for r in got:
            centroids[r["cluster"], r["at"]] = int(r["x"]) // r["n"]
        taken.append(sum(r["taken"] for r in got if r["at"] == 0))
    out = file.mapInArrow(_assigned(Nearest(grid, centroids), dims), f"id {kind}, cluster int, distance long")
    return stash(out), centroids, taken


def cluster_report(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each row of table
    whose vector has all of its components, finite ones.

    Rows whose vector is null, of another length, or has a null, NaN or infinity are left out;
    a component beyond 2^27 after scaling is an error. Repeated rows count each, ids may be
    null or repeated. With fewer vectors than centroids each is one. Other columns are
    ignored, whatever their names; an empty table gives none.
    """
    kept = stash(whole_vectors(table, id_col=id_col, vector_col=vector_col))
    found, centroids, _ = cluster(kept, **options)
    spark = table.sparkSession
    names = spark.createDataFrame([(i, hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest()) for i, c in enumerate(centroids)], "c int, centroid_sha256 string")
    own = found.groupBy(F.col("cluster").alias("c")).agg(F.sum("distance").alias("cluster_inertia"))
    # One row a centroid.
    own = own.join(F.broadcast(names), "c").crossJoin(F.broadcast(found.agg(F.sum("distance").alias("inertia"))))
    return found.join(F.broadcast(own), F.col("cluster") == F.col("c")).select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(f"""
d{i} AS MATERIALIZED (
  SELECT r, c, CAST(sum((v.x - e.x) * (v.x - e.x)) AS BIGINT) AS d FROM v JOIN c{i} e USING (p) GROUP BY r, c),
a{i} AS MATERIALIZED (SELECT r, c, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if i < ROUNDS:
            steps.append(f"""
c{i + 1} AS MATERIALIZED (
  SELECT c, p, CAST(coalesce((s - ((s % n) + n) % n) // n, x) AS BIGINT) AS x FROM c{i} LEFT JOIN (
    SELECT c, p, CAST(sum(v.x) AS BIGINT) AS s, count(*) AS n FROM a{i} JOIN v USING (r) GROUP BY c, p) USING (c, p))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: isfinite(x))) = {DIMS}),
v AS MATERIALIZED (
  SELECT r, unnest(range({DIMS})) AS p, CAST(floor({SCALE} * unnest(CAST(embedding AS DOUBLE[]))) AS BIGINT) AS x FROM kept),
first AS (SELECT r, row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, embedding) - 1 AS c FROM kept),
c0 AS MATERIALIZED (SELECT c, p, x FROM v JOIN first USING (r) WHERE c < {CENTROIDS}),{",".join(steps)},
name AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN kept USING (r) JOIN name USING (c)
"""


#: DuckDB twin of the report with its default settings.
ORACLE = _oracle()
