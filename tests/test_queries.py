"""Every registered catalog query against its SQL on the same tables."""

import duckdb
import pytest

from catalogspark import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _text(v):
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_like_sql(spark, sf_dir, duck, name):
    df = registry.queries()[name](spark, sf_dir)
    got = sorted(tuple(map(_text, r)) for r in df.select(*[f"`{c}`" for c in sorted(df.columns)]).collect())
    rel = duck.sql(ORACLES[name])
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    assert sorted(rel.columns) == sorted(df.columns)
    assert got == sorted(tuple(_text(r[i]) for i in at) for r in rel.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).schema == registry.queries()[registry.FLAGSHIP](spark, "/root/testdata/sf0.001").schema
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
