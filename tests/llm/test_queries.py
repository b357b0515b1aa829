import pytest

from lodemap.llm import queries

from ..conftest import SMALL


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(name, spark, same):
    same(queries.QUERIES[name](spark, SMALL), queries.ORACLES[name])


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].partition("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
