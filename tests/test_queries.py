"""Every query against its SQL, as the driver does."""

import os

import pytest

from tests.oracle import same
from weirflow import queries as own

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query(spark, name):
    df = own.QUERIES[name](spark, SF)
    if name in own.ORACLES:
        same(df, own.ORACLES[name], SF)
    else:
        assert df.count() > 0
