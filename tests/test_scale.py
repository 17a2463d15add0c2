"""Ranks, recursive series and the stream, where one task mustn't have all rows."""

import datetime as dt
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quaylark.operators import ranks
from quaylark.operators.recursive import Mixed, affine_scan, ema_step, fold, mixed_ema_step
from quaylark.streaming import ingest


@pytest.mark.parametrize("range_rows", [7, 1_000_000])
def test_percent_ranks_equal_pandas(spark, range_rows):
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=300), 1)
    v[:90] = 0.5  # a third of all rows share one value
    rows = [(f"k{i % 250}" if i % 50 else None, None if i % 17 == 0 else float("nan") if i % 19 == 0 else float(x), float(i)) for i, x in enumerate(v)]
    rows += [("same", 1.0, 1.0)] * 2
    got = ranks.percent_ranks(spark.createDataFrame(rows, "k string, v double, w double"), {"up": ("v", True), "down": ("v", False), "only": ("w", True)}, range_rows=range_rows)
    assert got.columns == ["k", "v", "w", "up", "down", "only"] and got.count() == len(rows)
    own = pd.Series([np.nan if r[1] is None else r[1] for r in rows])
    n = own.notna().sum() - 1
    up, down = (100 * (own.rank(method="min", ascending=a) - 1) / n for a in (True, False))
    only = 100 * (pd.Series([r[2] for r in rows]).rank(method="min") - 1) / (len(rows) - 1)
    key = lambda x: tuple("none" if y is None or y != y else f"{y:.9f}" if isinstance(y, float) else y for y in x)
    assert sorted(key(tuple(r)) for r in got.collect()) == sorted(key((*r, *x)) for r, *x in zip(rows, up, down, only))


def test_ranks_of_one_value_and_none(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", None)], "k string, v double")
    assert {r["k"]: r["s"] for r in ranks.percent_ranks(df, {"s": ("v", True)}).collect()} == {"a": 0.0, "b": None}
    assert ranks.percent_ranks(df.limit(0), {"s": ("v", True)}).count() == 0
    assert ranks.row_numbers(df.limit(0), [F.col("v")], "n").count() == 0


def test_many_rows_are_numbered_in_ranges(spark):
    df = spark.range(300_000).select(F.col("id"), (F.xxhash64("id") % 1000).alias("v"))
    got = ranks.row_numbers(df, [F.col("v").desc(), F.col("id")], "n", range_rows=20_000).toPandas().sort_values("n")
    assert got["n"].tolist() == list(range(1, 300_001))
    assert got[["v", "id"]].values.tolist() == got.sort_values(["v", "id"], ascending=[False, True])[["v", "id"]].values.tolist()
    # No window holds more than a range.
    plan = ranks.row_numbers(df, [F.col("v").desc(), F.col("id")], "n", range_rows=20_000)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan.split("== Optimized")[0]


def loop(a, b, y=0.0):
    out = []
    for x, z in zip(a, b):
        y = z if z != z or y != y else x * y + z
        out.append(y)
    return np.array(out)


def test_fold_equals_a_loop():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 63, 64, 65, 1000):
        a, b = rng.uniform(-1, 1, n), rng.normal(size=n)
        b[rng.random(n) < 0.1] = np.nan
        assert np.allclose(fold(a, b, 3.0), loop(a, b, 3.0), rtol=1e-12, atol=1e-12, equal_nan=True)
        assert np.allclose(fold(a, b, float("nan")), loop(a, b, float("nan")), rtol=1e-12, atol=1e-12, equal_nan=True)


@pytest.mark.parametrize("chunk", [4, 50, 8192])
def test_mixed_steps_in_the_same_pass(spark, chunk):
    rng = np.random.default_rng(6)
    x = rng.normal(size=120)
    rows = [(k, dt.date(2020, 1, 1) + dt.timedelta(i), float(v) * s, i + 1) for k, s in (("A", 1), ("B", 2)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "ticker string, date date, close double, rank int").withColumn("gap", F.when(F.col("rank") % 40 != 0, F.col("close")))
    rank, close = F.col("rank"), F.col("close")
    got = affine_scan(df, {
        "fast": ema_step(close, 3, rank), "slow": ema_step(close, 7, rank), "signal": mixed_ema_step({"fast": 1.0, "slow": -1.0}, 5, rank, 10),
        "gaps": (F.lit(0.5), F.col("gap")), "of_gaps": Mixed(F.lit(0.25), F.lit(2.0), {"gaps": 1.0}),
    }, chunk=chunk).orderBy("ticker", "date").toPandas()
    for k, own in got.groupby("ticker"):
        c = own["close"].reset_index(drop=True)
        fast, slow = (c.ewm(span=n, adjust=False).mean() for n in (3, 7))
        signal = (fast - slow)[9:].ewm(span=5, adjust=False).mean()
        gaps = loop(np.full(120, 0.5), own["gap"].to_numpy())
        for name, want in (("fast", fast), ("slow", slow), ("signal", [np.nan] * 9 + signal.tolist()), ("gaps", gaps), ("of_gaps", loop(np.full(120, 0.25), 2 * gaps))):
            assert np.allclose(own[name].to_numpy(), np.array(want), atol=1e-12, equal_nan=True), (k, name)


def test_a_million_rows_of_one_key(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit("A").alias("ticker"), "id", F.sin(F.col("id") / 50).alias("close"))
    got = affine_scan(df, {"y": ema_step(F.col("close"), 20, F.col("id") + 1), "z": mixed_ema_step({"y": -1.0}, 9, F.col("id") + 1)}, ts="id")
    want = pd.Series(np.sin(np.arange(n) / 50)).ewm(span=20, adjust=False).mean()
    z = (-want).ewm(span=9, adjust=False).mean()
    for r in got.where("id % 99991 = 0 or id = 999999").collect():
        assert abs(r["y"] - want[r["id"]]) < 1e-9 and abs(r["z"] - z[r["id"]]) < 1e-9


def event(i, user, day, batch=0):
    return (i, user, dt.datetime(2020, 1, 1) + dt.timedelta(days=day), "t", "{\"k\": %d}" % (10 * i + batch), 1.0)


SCHEMA = "event_id long, user_id long, ts timestamp, event_type string, props string, value double"


def state(spark, table):
    return {r["user_id"]: (r["event_id"], r["k"]) for r in ingest.latest_state(spark, table, ["user_id", "event_type"]).collect()}


@pytest.mark.parametrize("fold_every", [2, 1000])
def test_stream_of_files_in_reverse_order(spark, tmp_path, fold_every):
    days = [[event(10 * d + u, u, d) for u in range(5) if (u + d) % 2] for d in range(6)]
    source, table = tmp_path / "in", f"file://{tmp_path}/table"
    for n, rows in enumerate(reversed(days)):  # the newest events come first
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"file://{source}/{n}")
        query = ingest.upsert_stream(ingest.read_events(spark, f"file://{source}/*", SCHEMA), table, f"file://{tmp_path}/state", ["user_id", "event_type"], fold_every=fold_every)
        query.awaitTermination()
    want = {u: max((10 * d + u) for d in range(6) if (u + d) % 2) for u in range(5)}
    assert state(spark, table) == {u: (e, 10 * e) for u, e in want.items()}
    before = state(spark, table)
    # Batches run again, in any order, and a fold is repeated.
    for n in (3, 0):
        own = spark.createDataFrame(list(reversed(days))[n], SCHEMA).withColumn("k", F.from_json("props", "k INT")["k"])
        ingest.add_batch(own, table, n, ["user_id", "event_type"])
    ingest.fold(spark, table, 3, ["user_id", "event_type"])
    assert state(spark, table) == before


def test_a_batch_writes_no_more_than_it_has(spark, tmp_path):
    table, keys = f"file://{tmp_path}/table", ["user_id", "event_type"]
    big = spark.range(50_000).selectExpr("id AS event_id", "id AS user_id", "timestamp'2020-01-01' AS ts", "'t' AS event_type", "'{}' AS props", "0.5D AS value")
    ingest.add_batch(big, table, 0, keys)
    ingest.add_batch(spark.createDataFrame([event(99_999, 7, 3)], SCHEMA), table, 1, keys)
    size = lambda n: sum(f.stat().st_size for f in Path(tmp_path, f"table/batches/batch={n}").glob("*.parquet"))
    assert size(1) < 5_000 < 100_000 < size(0)
    got = ingest.latest_state(spark, table, keys)
    assert got.count() == 50_000 and got.where("user_id = 7").first()["event_id"] == 99_999
