"""Every query of the library against its SQL, or at least for its rows."""

import duckdb
import pytest

from lexiforge.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, con, name):
    got = registry.QUERIES[name](spark, sf)
    if name not in registry.ORACLE_SQL:
        assert got.count() > 0
        return
    cur = con.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted((tuple(map(plain, r)) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in got.select(*[f"`{c}`" for c in columns]).collect()), key=repr) == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id"]
    assert set(e.oracle_sql()) <= set(e.queries())
