"""Every registered query against its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from loomspan.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return f"{x:.9g}"
    return str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    rows = sorted([plain(r[c]) for c in cols] for r in df.collect())
    assert rows
    if name in ORACLE_SQL:
        found = duck.execute(ORACLE_SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == cols
        assert rows == sorted([plain(r[names.index(c)]) for c in cols] for r in found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 600
    assert set(entry.oracle_sql()) <= set(entry.queries())
