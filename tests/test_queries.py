"""Every query against its oracle on the smallest tables; none may be empty."""

from __future__ import annotations

import pytest

import __spark_entry__ as registry
from quireworks.queries import queries_of

from .oracle import same, tables

NAMES = [(m, n) for m in queries_of() for n in m.QUERIES]


@pytest.fixture(scope="module")
def con():
    return tables()


@pytest.mark.parametrize(("module", "name"), NAMES, ids=[n for _, n in NAMES])
def test_query(spark, con, module, name):
    assert same(spark, con, module.QUERIES[name], module.ORACLES[name]) > 0


def test_registry(spark):
    assert {n for _, n in NAMES} <= set(registry.queries())
    assert set(registry.oracle_sql()) <= set(registry.queries())
    found = registry.entry(spark)
    assert found.columns == ["category", "project", "file_id", "detail"] and found.count() > 0
