import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

from quaylark.operators import calendar, clean, ingest, intervals, news, performance, quality, serving
from quaylark.sources import tables


def test_upsert_modes_and_idempotence(spark):
    t = spark.createDataFrame([(1, "a", 5), (2, "b", 5), (3, "c", None)], "k int, v string, _ingested_at int")
    s = spark.createDataFrame([(1, "x", 6), (2, "y", 5), (3, "z", 9), (4, "n", 1)], "k int, v string, _ingested_at int")
    want = {"last": "xyzn", "newer": "xbcn", "insert": "abcn"}
    for mode, v in want.items():
        once = ingest.upsert(t, s, ["k"], mode=mode)
        assert "".join(r[1] for r in rows(once, "k", "v")) == v
        assert rows(ingest.upsert(once, s, ["k"], mode=mode), "k", "v") == rows(once, "k", "v")


def test_fetch_plan(spark):
    t = spark.createDataFrame([("a", dt.date(2020, 1, 10)), ("b", dt.date(2020, 1, 5))], "ticker string, date date")
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "ticker string")
    got = {r["ticker"]: r for r in ingest.fetch_plan(t, keys, "2020-01-11").collect()}
    assert got["a"]["outcome"] == "UP_TO_DATE" and got["b"]["fetch_from"] == dt.date(2020, 1, 6) and got["c"]["outcome"] == "FIRST_LOAD"


def test_interval_subtraction_and_merge(spark):
    d = lambda n: dt.date(2020, 1, n)
    want = spark.createDataFrame([("a", d(5), d(2), d(8)), ("a", d(20), d(17), d(23)), ("b", d(5), d(2), d(8)), ("a", d(10), d(9), d(12))], "ticker string, event_date date, start_date date, end_date date")
    have = spark.createDataFrame([("a", d(4), d(18))], "ticker string, first date, last date")
    rest = intervals.subtract(want, have)
    assert rows(rest, "ticker", "start_date", "end_date") == [("a", d(2), d(3)), ("a", d(19), d(23)), ("b", d(2), d(8))]
    touching = spark.createDataFrame([("a", d(1), d(1), d(2)), ("a", d(2), d(3), d(4)), ("a", d(9), d(6), d(7))], "ticker string, event_date date, start_date date, end_date date")
    assert rows(intervals.merge(touching), "start_date", "end_date", "events", "days") == [(d(1), d(4), 2, 4), (d(6), d(7), 1, 2)]


def test_market_holidays(spark):
    c = calendar.trading_calendar(spark, "2021-01-01", "2024-12-31")
    got = {str(r["date"]): r["holiday"] for r in c.where("holiday is not null").collect()}
    for day, name in {"2024-03-29": "Good Friday", "2023-04-07": "Good Friday", "2022-04-15": "Good Friday", "2021-12-24": "Christmas", "2022-12-26": "Christmas", "2023-01-02": "New Year's Day", "2024-05-27": "Memorial Day", "2024-11-28": "Thanksgiving", "2021-07-05": "Independence Day", "2022-06-20": "Juneteenth"}.items():
        assert got[day] == name
    assert str(c.where("date = '2024-03-31'").first()["last_open"]) == "2024-03-28"


def test_rules_split_rows(spark):
    df = spark.createDataFrame([("a", dt.date(2020, 1, 1), 1.0, 2.0, 0.5, 1.5, None, 1.0, None), ("a", None, 1.0, 2.0, 0.5, None, -1.0, 1.0, None)], "ticker string, date date, open double, high double, low double, close double, volume double, vwap double, transactions long")
    ok, bad = clean.split_valid(df, clean.price_rules())
    assert ok.count() == 1 and set(bad.first()["failed"]) >= {"key", "prices_positive", "volume"}


def test_quality_rules(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 3), (None, 4)], "k string, n int")
    out = quality.verdict(spark, [quality.unique("unique", df, ["k", "n"]), quality.row_rules(df, {"known": F.col("k").isNull(), "small": F.col("n") > 9}), quality.ranked("rank", df, "n", [])])
    assert {r["rule"]: r["violations"] for r in out.collect()} == {"unique": 1, "known": 1, "small": 0, "rank": 1, "ALL": 3}


def test_number_claims(spark):
    df = spark.createDataFrame([(1, "Up 12.5 to 1,234 (about 65.64 M) over 30 days since 2020-01-02 – loss −3.1"), (2, None)], "report_id int, text string")
    assert [(r["raw"], r["value"]) for r in serving.numeric_claims(df).orderBy("place").collect()] == [("12.5", 12.5), ("1,234", 1234.0), ("65.64M", 65_640_000.0), ("-3.1", -3.1)]
    src = spark.createDataFrame([(1, 12.52), (1, 1234.4), (1, 65_638_000.0), (2, 3.1)], "report_id int, value double")
    assert [r["grounded"] for r in serving.ground(df, src).orderBy("place").collect()] == [True, True, True, False]
    pairs = [("volume 1471", 1470.0, False), ("volume 1,470", 1470.0, True), ("it is 57 now", 57.14, True), ("it is 58 now", 57.14, False), ("3.1 more", -3.1, False), ("6.83% below the high", -6.8307, True), ("x 65.64 M", 65_637_842.0, True), ("-0.89", -0.8915, True)]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(pairs)], "report_id int, text string")
    src = spark.createDataFrame([(i, v) for i, (_, v, _) in enumerate(pairs)], "report_id int, value double")
    assert [r["grounded"] for r in serving.ground(df, src).orderBy("report_id").collect()] == [ok for _, _, ok in pairs]
    far = spark.createDataFrame([(1, "The loss came first. " + "Words " * 12 + "then 6.83 was seen")], "report_id int, text string")
    assert not serving.ground(far, spark.createDataFrame([(1, -6.8307)], "report_id int, value double")).first()["grounded"]
    assert "loss" not in serving.numeric_claims(far).first()["context"] and "6.83 was seen" in serving.numeric_claims(far).first()["context"]


def test_source_values(spark):
    df = spark.sql("SELECT 1 AS id, named_struct('a', 2.5D, 'b', true, 'c', DATE'2020-01-02', 'd', 'since 2021-03-04.') AS x, array(named_struct('v', 7, 'w', array(1, null)), null) AS l, cast(null as int) AS n, map('k', 9) AS m")
    values, days = serving.source_values(df, ["id"])
    assert sorted(r["value"] for r in values.collect()) == [1.0, 2.0, 2.5, 7.0, 9.0] and sorted(str(r["day"]) for r in days.collect()) == ["2020-01-02", "2021-03-04"]


def test_company_payload_and_duplicates(spark):
    df = spark.sql("SELECT ' A ' AS ticker, '12.5' AS market_cap, named_struct('city', 'Rome', 'state', 'LA') AS address, '2020-01-01' AS list_date")
    got = tables.flatten_company(df).first().asDict()
    assert got["ticker"] == "A" and got["city"] == "Rome" and got["address1"] is None and got["logo_url"] is None and got["market_cap"] == 12.5 and str(got["list_date"]) == "2020-01-01" and len(got) == 30
    rows = spark.createDataFrame([("a", "X"), ("a", "X"), ("a", "Y"), (None, "X"), ("b", "X")], "article_id string, requested_ticker string")
    got = news.duplicate_profile(rows).first()
    assert (got["n_rows"], got["n_ids"], got["n_keys"], got["repeated_keys"]) == (5, 2, 4, 1) and [tuple(x) for x in got["most"]] == [(-2, "a", "X")]


def test_percent_ranks(spark):
    rows = [("a", 1.0, 5.0), ("b", 2.0, None), ("c", 2.0, 1.0), ("d", None, 3.0)]
    got = {r["ticker"]: (r["up"], r["down"]) for r in performance.percent_ranks(spark.createDataFrame(rows, "ticker string, x double, y double"), {"up": ("x", True), "down": ("y", False)}).collect()}
    assert got == {"a": (0.0, 0.0), "b": (50.0, None), "c": (50.0, 100.0), "d": (None, 50.0)}


def test_typed_read(spark):
    df = spark.createDataFrame([("1", "2020-01-01T00:00:00Z", "x"), ("z", "never", "2")], "a string, t string, n string")
    got = tables.typed(df, {"a": "int", "t": "timestamp", "n": "int", "missing": "double"}).collect()
    assert got[0]["a"] == 1 and got[0]["n"] is None and got[1]["t"] is None and got[1]["missing"] is None


def test_company_rules(spark):
    df = spark.createDataFrame([(" a ", " Ann ", "NYSE ", -1.0, None), ("", "x", "us", None, 5), (None, " ", None, 0.0, 0)], "ticker string, name string, market string, market_cap double, round_lot long")
    df = df.withColumns({c: F.lit(None).cast("long") for c in clean.COMPANY_NUMBERS if c not in df.columns})
    got = [(r["ticker"], r["market"], ",".join(r["failed"])) for r in clean.judge(clean.normalise_companies(df), clean.company_rules()).collect()]
    assert got == [("A", "nyse", "market_cap"), ("", "us", "ticker"), (None, None, "ticker,name")]
    assert sum(map(len, clean.COMPANY_TEXT.values())) == 23


def test_levels_of_coverage(spark):
    day = dt.date
    rel = spark.createDataFrame([("A", day(2020, 1, 1)), ("A", day(2020, 2, 1)), ("B", day(2020, 2, 3))], "ticker string, published_date date")
    events = spark.createDataFrame([("A", day(2020, 2, 9)), ("C", day(2020, 3, 1))], "ticker string, date date")
    got = {(r["level"], r["ticker"], r["month"]): tuple(r)[3:] for r in news.coverage_levels(rel, events).collect()}
    assert got["ALL", None, None] == (3, day(2020, 1, 1), day(2020, 2, 3), 2, day(2020, 2, 9), day(2020, 3, 1))
    assert got["TICKER", "C", None] == (0, None, None, 1, day(2020, 3, 1), day(2020, 3, 1)) and got["MONTH", None, "2020-02"][0] == 2 and len(got) == 7


def test_rewriting_one_partition(spark, tmp_path):
    path, name = f"file://{tmp_path}/t", "t_rewrite"
    for _ in range(2):
        tables.ensure_table(spark, name, "k INT, v STRING, p INT", partition_by=["p"], path=path)
    try:
        tables.overwrite_partitions(spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, p int"), name)
        tables.overwrite_partitions(spark.createDataFrame([(3, 2, 7.5)], "k int, p int, extra double"), name)
        got = sorted(tuple(r) for r in spark.table(name).select("k", "v", "extra", "p").collect())
        assert got == [(1, "a", None, 1), (3, None, 7.5, 2)] and spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"
    finally:
        spark.sql(f"DROP TABLE {name}")


def test_limits_and_totals(spark):
    limits = spark.createDataFrame([("a", 0.0, 10.0), ("b", 90.0, None), ("c", None, 1.0)], "rule string, low double, high double")
    got = {r["rule"]: r["passed"] for r in quality.within(spark.createDataFrame([("a", 10.0), ("b", 89.0)], "rule string, value double"), limits).collect()}
    assert got == {"a": True, "b": False, "c": False}
    df = spark.createDataFrame([(3, 1, 2), (3, 1, 1), (1, 1, None)], "t int, x int, y int")
    assert [r["violations"] for r in quality.parts_add_up(df, {"r": ("t", ["x", "y"])}).collect()] == [1]


def test_audit_of_loads(spark):
    df = spark.createDataFrame([(i, None if i % 3 else "x", dt.datetime(2020, 1, 1 + i % 5)) for i in range(30)], "i int, t string, at timestamp")
    assert {r["name"]: (r["nulls"], r["n_rows"]) for r in ingest.null_audit(df).collect()} == {"i": (0, 30), "t": (20, 30), "at": (0, 30)}
    assert [(r["place"], r["i"]) for r in ingest.newest(df, "at", ["i"], n=7).orderBy("place").collect()] == list(zip(range(1, 8), [4, 9, 14, 19, 24, 29, 3]))
