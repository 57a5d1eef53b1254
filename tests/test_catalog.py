"""Every registered query against its SQL twin (or for rows) on the smallest given tables."""

import pytest

from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


def names():
    from lakesearch import catalog

    return sorted(catalog.QUERIES)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", names())
def test_query(spark, con, name):
    from lakesearch import catalog

    if name in catalog.SQL:
        assert compare(spark, con, SF, catalog.QUERIES[name], catalog.SQL[name]) is None
    else:
        assert catalog.QUERIES[name](spark, SF).count() > 0
