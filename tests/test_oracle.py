"""Every registered query against its SQL in DuckDB."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from flowlog.plans.oracle import ORACLE
from flowlog.plans.registry import QUERIES
from tests.oracle_check import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, con, name):
    assert compare(queries()[name](spark, SF_DIR), con, oracle_sql()[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(queries()) and set(ORACLE) <= set(oracle_sql())


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["ip", "has_psh", "targets_ssh", "targets_rdp", "many_syn_ports", "clean"]
    assert df.count() > 0
