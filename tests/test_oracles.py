"""Every registered query equals its SQL oracle on the smallest supplied tables."""

import pytest
from compare import compare

from siteloom.plans import REGISTRY


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_equals_oracle(spark, con, folder, name):
    q = REGISTRY[name]
    status, rows, _, note = compare(spark, con, name, q.run, q.oracle, folder)
    assert status in ("ok", "rows-only"), note
    assert rows >= 0
