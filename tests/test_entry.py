import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["bucket_totals", "top_words", "sentence_stats", "gap_chi2", "ledger_summary", "route_evaluation", "manifest_verify", "repeat_similarity"])
def test_columns_and_rows_match_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    got, want = entry.queries()[name](spark, FOLDER), con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    norm = lambda v: None if v is None else round(v, 5) if isinstance(v, float) else v
    assert sorted((tuple(map(norm, r)) for r in got.select(*columns).collect()), key=str) == sorted((tuple(map(norm, r)) for r in want.fetchall()), key=str)
