import pytest

from ledgerlake.plans import catalog
from tests.oracle import SF, compare


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_its_oracle(spark, name):
    assert compare(catalog.QUERIES[name](spark, SF), catalog.ORACLES[name]) >= 0


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, name):
    catalog.QUERIES[name](spark, SF).collect()
