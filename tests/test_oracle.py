"""Every registered query against its SQL on the same tables."""

from __future__ import annotations

import pytest
from compare import compare, duck

from __spark_entry__ import entry
from saldo.plans.oracle import ORACLE
from saldo.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, con):
    same, message = compare(QUERIES[name](spark, sf_dir), con, ORACLE[name])
    assert same, message
    assert "types differ" not in message, message


def test_entry(spark):
    assert entry(spark).count() > 0
