"""Every query with a SQL check must agree with it; the others must return rows."""

import pytest

import __spark_entry__ as entry_points
import compare

SF = "/root/testdata/sf0.001"
CHECKS = entry_points.oracle_sql()
QUERIES = entry_points.queries()
# Results that are rightly empty on the smallest tables.
MAY_BE_EMPTY = {"budget_frontier", "weak_name_links"}


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_matches_sql(spark, con, name):
    found = compare.differences(spark, con, SF, QUERIES[name], CHECKS[name])
    assert found is None or (name in MAY_BE_EMPTY and found == "no rows")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_runs(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows or name in MAY_BE_EMPTY


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
