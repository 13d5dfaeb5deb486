"""Every query with SQL gives what DuckDB gives for it."""

import os

import duckdb
import pytest

from geoloom.plans import oracles, queries

SQL = oracles.oracle_sql()


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    return float(f"{v:.9g}") if isinstance(v, float) else v


def same(spark, sf_dir, query, sql):
    frame = query(spark, sf_dir)
    names = sorted(frame.columns)
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for file in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{sf_dir}/{file}'")
    quoted = ", ".join(f'"{n}"' for n in names)
    want = sorted((tuple(map(plain, r)) for r in con.execute(f"SELECT {quoted} FROM ({sql})").fetchall()), key=str)
    got = sorted((tuple(map(plain, r)) for r in frame.select(*[f"`{n}`" for n in names]).collect()), key=str)
    assert got == want
    assert got


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    same(spark, sf_dir, queries.queries()[name], SQL[name])


def test_every_sql_has_its_query():
    assert set(SQL) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert queries.queries()[name](spark, sf_dir).count() > 0
