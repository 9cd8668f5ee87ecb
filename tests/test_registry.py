"""Every registered query against its SQL twin in DuckDB."""

import math

import duckdb
import pytest

from latticelake.plans import registry, repository  # noqa: F401  the second one registers further queries

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if hasattr(v, "is_finite"):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in BASE:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in registry.ORACLES:
        other = duck.sql(registry.ORACLES[name])
        assert sorted(other.columns) == columns
        at = [other.columns.index(c) for c in columns]
        assert got == sorted((tuple(plain(r[i]) for i in at) for r in other.fetchall()), key=repr)
