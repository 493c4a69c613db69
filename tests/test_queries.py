"""Each query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import tickframe.queries as q
import tickframe.replay_queries as surface

WHERE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    if not os.path.isdir(WHERE):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in os.listdir(WHERE):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{WHERE}/{t}'")
    return con


@pytest.mark.parametrize("name", q.QUERIES | surface.QUERIES)
def test_query_equals_its_sql(spark, tables, name):
    got = (q.QUERIES | surface.QUERIES)[name](spark, WHERE)
    columns = sorted(got.columns)
    want = tables.sql((q.ORACLE_SQL | surface.ORACLE_SQL)[name])
    assert sorted(want.columns) == columns
    rows = lambda found, names: sorted(repr([r[names.index(c)] for c in columns]) for r in found)
    assert rows(map(tuple, got.collect()), got.columns) == rows(want.fetchall(), want.columns)


def test_game_time_keeps_late_events(spark, tmp_path):
    spark.range(999_990, 1_000_010).withColumnRenamed("id", "event_id").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_id: r.game_time for r in q.QUERIES["game_time"](spark, str(tmp_path)).collect()}
    assert got == {k: k / 64 for k in range(999_990, 1_000_010)}  # exact as float below 2 ** 24
