"""Every registered query with SQL equals it on the smallest tables."""

import os

import duckdb
import pytest

from locusframe.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows):
    def one(x):
        return None if x is None else round(float(x), 6) if isinstance(x, int | float) and not isinstance(x, bool) else x

    return sorted(repr([one(x) for x in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    relation = duck.sql(registry.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    assert plain([r[c] for c in columns] for r in df.collect()) == plain(relation.select(*[f'"{c}"' for c in columns]).fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert registry.flagship(spark, SF).count() > 0
