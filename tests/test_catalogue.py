"""Every query of the engine that SQL can express, against DuckDB."""

import pytest

from loomtext.plans.catalogue import ORACLES, QUERIES
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert oracle.difference(spark, SF, QUERIES[name], ORACLES[name], 2e-6) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
