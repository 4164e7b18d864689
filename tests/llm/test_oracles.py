import pytest

from gatecrest.llm import queries
from tests.oracle import from_spark, from_sql


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_gives_what_its_sql_gives(spark, name, sf):
    d = f"/root/testdata/{sf}"
    assert from_spark(queries.queries()[name](spark, d)) == from_sql(queries.oracle_sql()[name], d)
