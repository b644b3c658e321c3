"""Every query with an SQL twin, against DuckDB on the same tables."""

import pytest

from checks.catalog import ORACLE, QUERIES
from checks.compare import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    with connect(sf_dir) as connection:
        yield connection


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf_dir, con, name):
    result, _, _ = compare(spark, con, QUERIES[name], ORACLE[name], sf_dir)
    assert result == "ok"


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
