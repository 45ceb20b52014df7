import pytest

from bitloom.plans import reference_queries, round_trips  # noqa: F401
from tests.oracle import check, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(reference_queries.ORACLES))
def test_same_rows_as_sql(name, con, spark, sf, tmp_path):
    check(con, reference_queries.QUERIES[name], reference_queries.ORACLES[name], spark, sf, tmp_path)


@pytest.mark.parametrize("name", [n for n in reference_queries.QUERIES if n not in reference_queries.ORACLES])
def test_runs_without_sql(name, spark, sf):
    rows = reference_queries.QUERIES[name](spark, sf)
    assert rows.columns
    assert rows.count() >= 0
