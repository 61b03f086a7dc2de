import pytest

from ledgerlake.llm import entries
from tests.oracle import SF, compare


@pytest.mark.parametrize("name", sorted(entries.ORACLES))
def test_query_matches_its_oracle(spark, name):
    assert compare(entries.QUERIES[name](spark, SF), entries.ORACLES[name]) > 0
