"""Every registered clinical query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from wardline.plans import clinical, flows, records  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(repr(round(r[i], 9) if isinstance(r[i], float) else r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(clinical.QUERIES))
def test_query_equals_sql(name, spark, con, sf_dir):
    df = clinical.QUERIES[name](spark, sf_dir)
    expected = con.sql(clinical.SQL[name])
    assert sorted(df.columns) == sorted(expected.columns)
    rows = expected.fetchall()
    assert canonical(df.collect(), df.columns) == canonical(rows, expected.columns)


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(clinical.QUERIES) == set(clinical.SQL)
    assert set(clinical.QUERIES) <= set(entry_module.queries())
