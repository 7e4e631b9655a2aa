"""Every query of the core against its SQL; those without SQL run and are tested elsewhere."""

import pytest

from attestry.plans import composed, logs, queries as Q, scores, stored  # noqa: F401

from .oracle import differences

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_against_sql(spark, name):
    assert differences(Q.QUERIES[name](spark, SMALL), Q.ORACLES[name], SMALL) == ""


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_runs(spark, name):
    assert Q.QUERIES[name](spark, SMALL).columns
