"""Every query on empty tables and on rows of nulls."""

import pytest

from quarry.llm import registry


@pytest.mark.parametrize("kind", ["empty", "null"])
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_no_rows_or_values(spark, bare, name, kind):
    registry.queries()[name](spark, bare[kind]).collect()
