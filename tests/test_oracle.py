"""Every query against its SQL on the smallest tables."""

import pytest
from compare import compare, duck

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    assert compare(spark, con, SF, queries()[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(queries()) - set(SQL)))
def test_gives_rows(spark, name):
    assert queries()[name](spark, SF).count() > 0


def test_forest_of_every_treatment(spark):
    found = {r.treatment_var for r in queries()["fit_forest"](spark, SF).collect()}
    assert found == {"quantity", "discount", "tax", "extendedprice"}


def test_entry(spark):
    assert entry(spark).columns == ["treatment_var", "score"]
