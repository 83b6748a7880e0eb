import pytest

from lexmill.plans.catalog import ORACLE_SQL, QUERIES
from tests.conftest import DATA, compare


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_duckdb(spark, tiny, name):
    left, right = compare(spark, tiny, QUERIES[name], ORACLE_SQL[name])
    assert left == right
    assert left[1], "a query that returns nothing proves nothing"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs_without_twin(spark, tiny, name):
    assert QUERIES[name](spark, tiny).count() > 0


def test_answers_where_some_queries_have_no_embedding(spark):
    """Half of the queries of this table have no embedding, so that nothing is found for them."""
    left, right = compare(spark, f"{DATA}/sf0.01", QUERIES["answer_sources"], ORACLE_SQL["answer_sources"])
    assert left == right and len(left[1]) == 25
