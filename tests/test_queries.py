import pytest

from cirrostrat import queries
from tests.compare import DATA, check, views

SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return views()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    check(spark, con, queries.queries()[name], SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns[:2] == ["t_min", "t_max"]
    # one-row grid: the survivors at 190 K
    assert df.where("accepted").selectExpr("coalesce(sum(n), 0) as n").first().n == 6
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_tables_are_there():
    import os

    assert os.path.isdir(DATA)
