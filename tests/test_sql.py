import pytest

import tallyfield.plans  # noqa: F401
from tallyfield.catalog import QUERIES, SQL
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    assert compare(spark, QUERIES[name], SQL[name], "/root/testdata/sf0.01") > 0
