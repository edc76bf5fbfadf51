"""Every registered query against its DuckDB oracle on the smallest driver data."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracles import compare, duck  # noqa: E402
from conftest import SMALL_SF  # noqa: E402

from medledger.plans import catalog  # noqa: E402

QUERIES = catalog.QUERIES  # the training-data queries have tests of their own
ORACLES = catalog.ORACLES


@pytest.fixture(scope="module")
def con():
    return duck(SMALL_SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, SMALL_SF, name, QUERIES[name], ORACLES.get(name), con)
    assert r.get("ok", True), r


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)


def test_entry_has_every_query():
    assert set(QUERIES) <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["Doctor_ID", "Full_Name", "Total_Appointments", "Completed_Appointments"]
    assert df.count() > 0
