"""Every registered query with SQL gives the rows DuckDB gives."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry_points  # noqa: E402
from tests import compare  # noqa: E402

SQL = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return compare.connect(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, folder, con, name):
    assert compare.differences(entry_points.queries()[name](spark, folder), con, SQL[name]) == ""


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() == 10
