"""Every query with a SQL twin gives the twin's rows."""

import math

import duckdb
import pytest

from corpusmith.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return str(x) if hasattr(x, "isoformat") else x


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_twin(spark, sf_dir, duck, name):
    df = catalog.queries()[name](spark, sf_dir)
    twin = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in twin.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, twin.fetchall())


def test_queries_without_twin_run(spark, sf_dir):
    for name in sorted(set(catalog.queries()) - set(catalog.oracle_sql())):
        assert catalog.queries()[name](spark, sf_dir).count() > 0, name
