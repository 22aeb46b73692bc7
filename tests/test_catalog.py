"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from oracle import connect, differences

from __spark_entry__ import entry
from strandmill.plans.catalog import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert differences(spark, con, QUERIES[name], ORACLES[name], SF_DIR) is None


def test_entry(spark):
    assert entry(spark).count() > 0
