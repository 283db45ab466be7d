"""Queries that SQL can express, against their SQL on the smallest tables."""

from __future__ import annotations

import pytest

from checks.compare import duckdb_tables, mismatch, type_differences
from lumberline.llm.oracles import ORACLES
from lumberline.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return duckdb_tables(SF_DIR)


def test_every_operator_is_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert ORACLES.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, tables, name):
    got = QUERIES[name](spark, SF_DIR)
    relation = tables.execute(ORACLES[name])
    assert type_differences(dict(got.dtypes), relation) == []
    assert mismatch(got.toPandas(), relation.fetchdf()) is None
