"""Every registered query against its SQL on DuckDB, over whole tables."""

import pytest
from compare import differences, duck

from gitgauge.plans.catalog import queries
from gitgauge.plans.oracles import oracle_sql

SQL = oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_sql():
    assert set(queries()) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf_dir, con, name):
    assert not differences(queries()[name](spark, sf_dir), con, SQL[name])
