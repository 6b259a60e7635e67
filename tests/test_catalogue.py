import pytest

from mailspan.plans import catalogue
from tests.helpers import SMALL, assert_same, duck

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def sql():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    if name in SQL:
        assert_same(got, sql.execute(SQL[name]).df())
    else:
        assert len(got)


def test_whole_tables_are_answered(spark, sql):
    count = lambda q: sql.execute(q).fetchone()[0]
    ago = QUERIES["relative_time_whole"](spark, SMALL)
    assert ago.count() == count("select count(*) from events") and not ago.filter("ago rlike '^[0-9]{2}[.]'").isEmpty()
    assert QUERIES["match_type_whole"](spark, SMALL).filter("role = 'RECEIVER'").count() == count("select count(*) from orders")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
