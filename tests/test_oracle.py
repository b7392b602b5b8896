"""Every query that has oracle SQL gives the oracle's rows."""

from __future__ import annotations

import math

import duckdb
import pytest

from lakeloom.plans import registry
from lakeloom.plans.sql_queries import TABLES

ORACLES = registry.oracles()


def value(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, float):
        return float(f"{x:.10g}")
    return str(x) if not isinstance(x, (int, bool)) else x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(value(r[k]) for k in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def oracle(sf):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf, oracle, name):
    got = registry.queries()[name](spark, sf)
    found = oracle.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(names, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLES)))
def test_other_query_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0
