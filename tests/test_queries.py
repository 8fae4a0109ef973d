"""Every registered query of the reference's operators against its SQL, at the smallest scale."""

import pytest

from passages.plans import registry
from tests.compare import DATA, spark_rows, sql_rows

FOLDER = DATA / "sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, str(FOLDER))) == sql_rows(SQL[name], FOLDER)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, str(FOLDER)).count() > 0
