"""Every query with SQL gives DuckDB's rows on the small tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

from masonry import plans  # noqa: E402


def _value(x):
    return round(x, 6) if isinstance(x, float) else x


def _sorted(rows):
    return sorted((tuple(map(_value, r)) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    want = con.execute(plans.oracle_sql()[name])
    columns = sorted(d[0] for d in want.description)
    frame = plans.queries()[name](spark, SF)
    assert sorted(frame.columns) == columns
    order = [d[0] for d in want.description]
    got = _sorted(frame.select(*order).collect())
    assert got == _sorted(want.fetchall())
    assert got
