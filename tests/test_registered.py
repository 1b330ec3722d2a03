"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__
from tools.check_queries import compare, oracle
from kpiweave.workload import all_entries

ENTRIES = all_entries()


@pytest.fixture(scope="module")
def connection(data):
    return oracle(data)


@pytest.mark.parametrize("name", sorted(ENTRIES))
def test_query_agrees_with_its_sql(spark, connection, data, name):
    assert compare(spark, connection, name, ENTRIES[name], data) is None


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).columns == ["hour_ts", "region", "traffic", "samples"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert not any(name.startswith("op") and name[2:3].isdigit() for name in ENTRIES)
