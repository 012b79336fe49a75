import pytest
from oracle import check

from lapgrid import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, sf, name):
    check(catalog.QUERIES[name](spark, sf), catalog.SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    assert df.count() > 0 and df.columns
