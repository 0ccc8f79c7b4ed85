"""Every registered query equals its DuckDB statement on sf0.001 (rows, columns, values)."""

import pytest

import __spark_entry__ as E
from tests.compare import compare, duck
from tests.conftest import SMALL

SQL = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, con, name):
    ok, msg, _, _ = compare(spark, con, name, QUERIES[name], SQL[name], SMALL)
    assert ok, msg


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SMALL).count() >= 0


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["model_id", "primary", "n_issues", "share", "keywords", "issue_rank"]
    assert df.count() > 0
