"""Every registered query of the library proper against its SQL on DuckDB."""

import math

import duckdb
import pytest

from docquery.plans.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v + 0.0:.9g}"
    if isinstance(v, bool) or v is None:
        return v
    return f"{float(v):.9g}" if isinstance(v, int) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    found = QUERIES[name](spark, sf)
    columns = sorted(found.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=str)
    if name in ORACLES:
        rel = con.sql(ORACLES[name])
        assert sorted(rel.columns) == columns
        assert got == sorted((tuple(plain(r[rel.columns.index(c)]) for c in columns) for r in rel.fetchall()), key=str)
