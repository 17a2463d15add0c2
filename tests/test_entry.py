from pathlib import Path

import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
OWN = sorted(n for n in entry.queries() if not n.startswith("op") and n != "pipeline")


def test_twins_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not Path(D).exists(), reason="no test data")
@pytest.mark.parametrize("name", [n for n in OWN if n in ("g_daily_metrics", "t_indicators", "a_by_key", "n_summary", "i_summary", "r_top_news", "s_upsert_newer", "v_backfill_plan", "v_freshness", "q_watchlist", "q_report_verdicts", "st_newest_events")])
def test_query_equals_its_twin(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "customer part lineitem events documents labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    df = entry.queries()[name](spark, D)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    norm = lambda rows: sorted(tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in rows)
    assert norm(tuple(r) for r in df.select(*cols).collect()) == norm(want)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_nothing_else_imports_the_training_data_operators():
    for f in (Path(entry.__file__).parent / "quaylark").rglob("*.py"):
        assert "llm" in f.parts or "quaylark.llm" not in f.read_text(), f
