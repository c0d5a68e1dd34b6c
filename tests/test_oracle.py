"""Every query that SQL can express gives the same rows as DuckDB; the others run."""

import pytest
from oracle import DATA, compare

from corpusloom.plans import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert compare(QUERIES[name](spark, DATA), SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0
