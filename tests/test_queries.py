"""Every query against its SQL, on the smallest test tables."""

import os
from pathlib import Path

import duckdb
import pytest

from papergrid.plans.oracle import ORACLES
from papergrid.plans.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, tmp_path, name):
    QUERIES[name](spark, SF).write.parquet(str(tmp_path / "got"))
    con.execute(f"create or replace table want as {ORACLES[name]}")
    got = f"read_parquet('{tmp_path}/got/*.parquet')"
    columns = lambda t: sorted((r[0], r[1]) for r in con.execute(f"describe select * from {t}").fetchall())
    assert columns(got) == columns("want")
    cols = ", ".join(f'"{c}"' for c, _ in columns("want"))
    for a, b in ((got, "want"), ("want", got)):
        assert con.execute(f"select count(*) from (select {cols} from {a} except all select {cols} from {b})").fetchall() == [(0,)]
    assert con.execute("select count(*) > 0 from want").fetchall() == [(True,)]
