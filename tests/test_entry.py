import os

import duckdb
import pytest

import __spark_entry__ as entry
from quarry import catalog_made as catalog
from quarry.catalog import ORACLES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    if not os.path.exists(DATA):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(rows, names):
    show = lambda v: None if v is None or v != v else f"{v:.6g}" if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted([tuple(str(show(r[k])) for k in order) for r in rows])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sql, name):
    df = catalog.QUERIES[name](spark, DATA)
    found = sql.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert plain(df.collect(), df.columns) == plain(found.fetchall(), names)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() == 20
