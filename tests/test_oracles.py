import pytest

from orebed import queries
from tests.oracle import SF, compare

Q, S = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(S))
def test_query_equals_sql(spark, name):
    compare(spark, name, Q[name], S[name])


@pytest.mark.parametrize("name", sorted(set(Q) - set(S)))
def test_query_runs(spark, name):
    assert Q[name](spark, SF).count() > 0
