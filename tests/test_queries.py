"""Every query of the core against the same in SQL."""

import pytest

from tidelog.plans import p_queries, store_queries

MODULES = (p_queries, store_queries)
WITH_SQL = [(m, n) for m in MODULES for n in m.SQL]


@pytest.mark.parametrize("module,name", WITH_SQL, ids=[n for _, n in WITH_SQL])
def test_equals_sql(module, name, compare):
    compare(module.QUERIES[name], module.SQL[name])


def test_every_sql_has_a_query():
    assert all(n in m.QUERIES for m, n in WITH_SQL)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
