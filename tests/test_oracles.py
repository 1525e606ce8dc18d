"""Every registered annotation query against its oracle, and the entry module."""

from __future__ import annotations

import pytest

import __spark_entry__
from marginalia.queries import ORACLES, QUERIES
from tests.compare import differences, duck


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_oracle(spark, sf_dir, name):
    assert differences(spark, sf_dir, name, QUERIES[name], ORACLES[name], duck(sf_dir)) == []


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_oracles_are_registered_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
