"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import compare, duck

from folioflow.plans import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    assert name in ORACLE
    assert compare(df, con, ORACLE[name]) == ""
