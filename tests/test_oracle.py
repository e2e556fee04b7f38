"""Every registered query against its SQL counterpart on the smallest tables."""

from __future__ import annotations

import pytest
from conftest import FOLDER

import __spark_entry__ as entry_module
from compare import check, connect

QUERIES, ORACLE = entry_module.queries(), entry_module.oracle_sql()
# These need more history than the smallest tables have.
MAY_BE_EMPTY = {
    "D3_training_store", "D4_isolation_forest", "E3_storm_events", "M1_summed_threshold", "Q1_list_anomalies",
    "Q3_search_logs", "T6_digests",
}


@pytest.fixture(scope="session")
def duck():
    return connect(FOLDER)


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    problem = check(spark, duck, FOLDER, name, QUERIES[name], ORACLE.get(name))
    if problem == "no rows" and name in MAY_BE_EMPTY:
        return
    assert problem is None, problem
