"""Every query of the catalog against its SQL."""

import pytest
from oracle import compare, connect

from veritrove import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, con, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    if name in catalog.ORACLES:
        assert compare(df, con, catalog.ORACLES[name]) == ""
    else:
        assert df.count() > 0
