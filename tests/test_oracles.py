"""Every query with SQL of its own gives the same rows in another engine."""

import math

import duckdb
import pytest

from roadlens.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(round(v, 9)) if isinstance(v, float) else str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, duck, data, name):
    df = catalog.QUERIES[name](spark, data)
    cursor = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert rows(df.columns, df.collect()) == rows(names, cursor.fetchall())


LIGHT = [n for n in catalog.QUERIES if n not in catalog.ORACLES and n not in ("ml_compare", "ml_sweep", "ml_grid", "ml_cv", "ml_group_cv")]


@pytest.mark.parametrize("name", LIGHT)
def test_has_rows(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() > 0
