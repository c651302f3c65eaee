"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from quillspark.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 9) + 0.0)
    if isinstance(value, (list, tuple)):
        return repr([plain(x) for x in value])
    return repr(float(value)) if type(value).__name__ == "Decimal" else str(value)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, db, name):
    mine = catalog.QUERIES[name](spark, SF)
    theirs = db.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(mine.columns) == sorted(columns)
    rows = sorted(str([plain(r[c]) for c in sorted(columns)]) for r in mine.collect())
    assert rows == sorted(str([plain(r[columns.index(c)]) for c in sorted(columns)]) for r in theirs.fetchall())


def test_flagship_is_registered():
    assert catalog.FLAGSHIP in catalog.QUERIES
