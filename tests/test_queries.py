"""Each graph query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from motifloom import queries

SF = "/root/testdata/sf0.001"
#: Replays that take long; test_streaming.py holds these engines against static runs. MOTIFLOOM_LONG=1 runs them here too.
LONG = () if os.environ.get("MOTIFLOOM_LONG") else ("stream_keyword", "stream_symmetric", "stream_kept_triangles", "stream_pfilter", "stream_color", "miner_stream")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", [n for n in queries.queries() if n not in LONG])
def test_query(spark, duck, name):
    got = queries.queries()[name](spark, SF)
    want = duck.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())
