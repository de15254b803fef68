"""Every query with SQL equals DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from cloudsift.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return db


def plain(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, duck, name):
    own = catalogue.queries()[name](spark, str(DATA))
    rows = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in rows.description]
    assert sorted(own.columns) == sorted(names)
    want = sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names)) for r in rows.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in own.collect()) == want
