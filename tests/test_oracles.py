"""Every query outside the llm subpackage that has SQL agrees with DuckDB on it."""

import pytest
from helpers import agree

from mnemoloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_agrees_with_sql(spark, sf, name):
    agree(registry.queries()[name](spark, sf), registry.oracle_sql()[name], sf)
