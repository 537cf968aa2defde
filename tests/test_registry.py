"""Every registered query against its SQL, on the smallest data."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as entry_points  # noqa: E402
from check import compare, tables  # noqa: E402
from headway.registry import ORACLES, QUERIES  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return tables(SMALL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, connection, name):
    assert compare(spark, connection, SMALL, name) is None


def test_entry_points(spark):
    assert set(ORACLES) <= set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert entry_points.entry(spark).count() > 0
