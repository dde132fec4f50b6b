"""Every registered query with SQL, against DuckDB on whole tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry
from compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
STATEMENTS = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_statement_has_a_query():
    assert set(STATEMENTS) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_same_result(spark, duck, name):
    problem = differences(entry.queries()[name](spark, FOLDER), duck.execute(STATEMENTS[name]))
    assert problem is None, problem


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 5 and df.columns == ["model", "rmse", "mae", "r2", "mape", "smape"]
