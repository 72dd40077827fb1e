"""Every query of the catalogue against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from chronolith.catalogue import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(values):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in v) for v in values), key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, str(DATA))
    columns = sorted(got.columns)
    want = db.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert rows(tuple(r[c] for c in columns) for r in got.collect()) == rows(tuple(r[i] for i in at) for r in want.fetchall())
