"""Every query that has SQL gives the rows of that SQL."""

import pytest
from conftest import same_rows

from evenspan import plans  # noqa: F401
from evenspan.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(name, spark, sf, duck):
    got, want = same_rows(QUERIES[name](spark, sf), duck, ORACLES[name])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark, sf):
    frame = QUERIES[name](spark, sf)
    assert frame.columns and frame.count() > 0
