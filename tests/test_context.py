"""The research context: parts, limits of lists, and its two readings."""

from pathlib import Path

import pytest

from quaylark.operators import context as cx
from quaylark.operators import serving as sv
from quaylark.plans import research, serving
from quaylark.sources import fixtures as fx

D = "/root/testdata/sf0.001"

LISTS = ("recent_daily", "recent", "news_context")


def rows(spark, part, days, more=""):
    """Rows of a part's columns for key A, one a day: days as such, event ids from the day, else 1.23456."""
    day = {"date", "published_date", "event_date"}
    cols = ", ".join(f"d AS {c}" if c in day else f"concat('e', d) AS {c}" if c == "event_id" else f"1.23456D AS {c}" for c in cx.PARTS[part])
    at = ", ".join(f"DATE'{d}'" for d in days)
    return spark.sql(f"SELECT 'A' AS ticker, {cols}{more} FROM (SELECT explode(cast(array({at}) AS array<date>)) AS d)")


def made(spark, days, keys):
    names = {"company": "companies", "market": "metrics", "performance": "performance", "technical": "indicators", "summary": "summary", "recent_daily": "daily", "recent": "events", "news_context": "impacts"}
    more = {"recent": ", d <> DATE'2020-01-09' AS is_anomaly"}
    own = {n: rows(spark, p, days[-1:] if p in ("company", "performance", "summary") else days, more.get(p, "")) for p, n in names.items()}
    # What the event says comes from the events.
    own["impacts"] = own["impacts"].drop("anomaly_score", "severity", "explanation", "market_condition")
    return cx.key_contexts(spark.createDataFrame(keys, "ticker string"), **own)


def test_key_contexts(spark):
    days = [f"2020-01-{i:02d}" for i in range(1, 10)]
    got = {r["ticker"]: r for r in made(spark, days, [("A",), ("A",), ("B",), (None,)]).collect()}
    assert sorted(got) == ["A", "B"]
    a, b = got["A"], got["B"]
    assert str(a["market"]["date"]) == str(a["technical"]["date"]) == "2020-01-09" and a["market"]["close"] == 1.2346
    assert [str(x["published_date"]) for x in a["news"]["recent_daily"]] == days[:1:-1]
    # The ninth day is no anomaly, and its summary isn't told of by an event.
    assert [str(x["date"]) for x in a["anomalies"]["recent"]] == days[7:2:-1]
    assert [x["anomaly_score"] for x in a["anomalies"]["news_context"]] == [None, 1.2346, 1.2346, 1.2346, 1.2346]
    assert b["company"] is None and b["news"]["summary"] is None and b["news"]["recent_daily"] == b["anomalies"]["recent"] == b["anomalies"]["news_context"] == []


def test_empty_tables(spark):
    got = made(spark, ["2020-01-01"], [("B",)]).union(made(spark, ["2020-01-01"], [])).collect()
    assert len(got) == 1 and got[0]["market"] is None


@pytest.mark.parametrize("users", [[(1, "Ada")], []])
def test_pairs_and_readings(spark, users):
    watch = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A")], "user_id int, ticker string")
    c = cx.research_context(watch, spark.createDataFrame(users, "user_id int, name string"), made(spark, ["2020-01-01", "2020-01-02"], [("A",), ("B",)])).cache()
    assert c.count() == 3
    keys = ["user_id", "ticker"]
    read = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    typed, parsed = read(cx.context_leaves(c, keys)), read(cx.document_leaves(cx.as_json(c, keys), keys))
    assert typed == parsed and (1, "A", "$.anomalies.recent[1].date", None, "2020-01-01") in typed
    assert (1, "B", "$.user.name", None, "Ada") in typed or not users


def test_documents_of_any_shape(spark):
    texts = [(1, '{"a": [1, {"b": true}, [], {}, null, 2.5], "c": "x", "d": 1e300}'), (2, "7"), (3, "{bad"), (4, None), (5, ""), (6, "[]"), (7, "null")]
    got = cx.document_leaves(spark.createDataFrame(texts, "id int, document string"), ["id"]).collect()
    assert sorted((r["id"], r["path"], r["number"], r["text"]) for r in got) == [
        (1, "$.a[0]", 1.0, None), (1, "$.a[1].b", None, "true"), (1, "$.a[5]", 2.5, None), (1, "$.c", None, "x"), (1, "$.d", 1e300, None), (2, "$", 7.0, None)]


def test_pair_leaves_reads_each_document_once(spark):
    """The values of a pair's document, though documents are read once a user and once a key."""
    watch = spark.createDataFrame([(i, t) for i in range(1, 9) for t in ("A", "B", None)] + [(99, "A")], "user_id int, ticker string")
    users = spark.createDataFrame([(i, f"N{i}") for i in range(1, 9)], "user_id int, name string")
    c, keys, seen = made(spark, ["2020-01-01", "2020-01-02"], [("A",), ("B",)]).cache(), ["user_id", "ticker"], []

    def read(df, by):
        seen.append(df.count())
        return cx.document_leaves(cx.as_json(df, by), by)

    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert rows(cx.pair_leaves(watch, users, c, read)) == rows(cx.context_leaves(cx.research_context(watch, users, c), keys)) and seen == [8, 2]


@pytest.mark.skipif(not Path(D).exists(), reason="no test data")
def test_lineitems_are_read_once(spark, monkeypatch):
    reads, bars = [], fx.bars
    monkeypatch.setattr(fx, "bars", lambda s, d: reads.append(d) or bars(s, d))
    assert research.contexts(spark, D)[2].count() == 27 and len(reads) == 1


def test_value_sets_are_the_source_values(spark):
    df = spark.sql("SELECT 1 AS id, array(1.5D, 0.0D, -0.0D, null, 1.5D) AS x, 'on 2020-01-02 and 2020-02-31' AS t UNION ALL SELECT 2, null, null")
    values, days = sv.source_values(df, ["id"])
    got = {r["id"]: r for r in sv.value_sets(df, ["id"]).collect()}
    assert sorted(got[1]["values"]) == sorted(r["value"] for r in values.collect()) == [0.0, 1.5, 5.0]
    assert got[1]["days"] == [r["day"] for r in days.collect()] and got[2]["values"] == got[2]["days"] == []


@pytest.mark.skipif(not Path(D).exists(), reason="no test data")
def test_reports_read_lineitems_once(spark, monkeypatch):
    reads, table = [], fx.table
    monkeypatch.setattr(fx, "table", lambda s, d, name: reads.append(name) or table(s, d, name))
    df = serving.verdict_rows(spark, D)
    assert df.count() > 0 and reads.count("lineitem") == 1 and "l_orderkey" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_a_report_meets_its_values_once(spark):
    reports = spark.createDataFrame([(1, "up 12.5 and 77.25, not 3.25"), (2, "at 12.5"), (3, None)], "report_id int, text string")
    got = sv.ground(reports, spark.createDataFrame([(1, 12.5), (1, 77.25), (1, None), (2, None), (4, 12.5)], "report_id int, value double"))
    assert sorted((r["report_id"], r["value"], r["grounded"]) for r in got.collect()) == [(1, 3.25, False), (1, 12.5, True), (1, 77.25, True), (2, 12.5, False)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
