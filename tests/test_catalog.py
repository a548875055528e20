"""Every query of the catalogue against its SQL twin, or for its rows."""

import duckdb
import pytest

from gleanery.plans import catalog, documents, markup, reader, service  # noqa: F401  (their queries are in the catalogue)

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES.split():
        con.execute(f"create view {name} as select * from '{DIR}/{name}.parquet'")
    return con


def rows(found):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sql, name):
    got = catalog.QUERIES[name](spark, DIR)
    if name not in catalog.ORACLE:
        assert got.count() > 0 or name == "search_trigram"
        return
    want = sql.execute(catalog.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(map(tuple, got.select(columns).collect())) == rows(want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
