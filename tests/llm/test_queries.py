from __future__ import annotations

import pytest

from quireworks.llm.queries import ORACLES, QUERIES

from ..oracle import same, tables


@pytest.fixture(scope="module")
def con():
    return tables()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    assert same(spark, con, QUERIES[name], ORACLES[name]) > 0
