"""Every named query against its SQL on the smallest test tables."""

import os

import pytest

from reuselake.plans import all_oracles, all_queries
from tests.oracle import compare, connect

PATH = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(PATH), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(PATH)


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_same_as_sql(spark, con, name):
    assert compare(all_queries()[name](spark, PATH), con, all_oracles()[name]) == []


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_oracles())))
def test_runs(spark, name):
    assert all_queries()[name](spark, PATH).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    row = entry.entry(spark).first()
    assert (str(row.net_revenue_usd), row.active_customers) == ("3815982.12", 39)
    assert row.arpac_usd == pytest.approx(97845.69538461539)
