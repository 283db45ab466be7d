"""Every registered query against its checking SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from checks.compare import duckdb_tables, mismatch, type_differences
from checks.oracles import ORACLES
from checks.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return duckdb_tables(SF_DIR)


def test_every_query_has_its_sql():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    got = QUERIES[name](spark, SF_DIR)
    relation = tables.execute(ORACLES[name])
    assert type_differences(dict(got.dtypes), relation) == []
    assert mismatch(got.toPandas(), relation.fetchdf()) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["file", "line_no", "log", "regex"]
