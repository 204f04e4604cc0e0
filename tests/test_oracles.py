"""Every registered query of the reference's own operators against its DuckDB twin."""

from __future__ import annotations

import pytest

from lumenspark import plans
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, name):
    assert name in plans.ORACLES
    assert compare(spark, name, plans.QUERIES[name], plans.ORACLES[name], "/root/testdata/sf0.001") == ""
