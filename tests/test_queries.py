"""Every registered query against its SQL on the smallest tables."""

import decimal

import duckdb
import pytest

import __spark_entry__ as entry_points

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES, CHECKS = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


def _comparable(value):
    if isinstance(value, float):
        return round(value, 6)
    return float(value) if isinstance(value, decimal.Decimal) else value


def _rows(rows):
    return sorted(
        (tuple(_comparable(v) for v in row) for row in rows),
        key=lambda r: tuple((v is None, str(v)) for v in r),
    )


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    found = _rows([row[c] for c in columns] for row in df.collect())
    result = duck.execute(CHECKS[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    wanted = _rows([row[names.index(c)] for c in columns] for row in result.fetchall())
    assert found == wanted


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["fingerprint", "cnt"]
