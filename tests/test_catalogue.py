"""Every query with a DuckDB text gives its rows; the others run."""

import os

import pytest
from compare import both

from pantrylake.plans.catalogue import oracle_sql, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    if name not in oracle_sql():
        assert queries()[name](spark, SF).count() >= 0
        return
    got, want, _ = both(spark, queries()[name], oracle_sql()[name], SF)
    assert got == want


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
