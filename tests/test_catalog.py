"""Every named query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from driftloom.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _norm(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    text = lambda v: "null" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name in catalog.SQL:
        want = db.sql(catalog.SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert _norm(df.columns, rows) == _norm(want.columns, want.fetchall())
    else:
        assert rows
