"""Every registered query with a DuckDB twin gives the same rows."""

import decimal
import math

import duckdb
import pytest

from kinelake.plans import registry

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else (0.0 if v == 0 else float(f"{v:.9g}"))
    return v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_like_duckdb(spark, duck, name):
    df = registry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    cur = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in cur.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs_twice_alike(spark, name):
    rows = [sorted(map(str, registry.queries()[name](spark, SMALL).collect())) for _ in range(2)]
    assert rows[0] and rows[0] == rows[1]
