import pytest
from conftest import DATA, same_rows

from lodestar.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    sql = catalogue.oracle_sql().get(name)
    if sql:
        assert same_rows(df, duck.execute(sql))
    else:
        assert df.count() > 0


def test_entry_without_llm():
    import __spark_entry__ as e

    assert set(catalogue.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
