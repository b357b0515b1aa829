import pytest

from lodemap.plans import catalogue

from .conftest import SMALL


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(name, spark, same):
    df = catalogue.queries()[name](spark, SMALL)
    if name in catalogue.oracles():
        same(df, catalogue.oracles()[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
