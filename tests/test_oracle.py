"""Every registered query against its SQL in DuckDB."""

import oracle
import pytest

import __spark_entry__ as entry_point

QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = oracle.connect(sf_dir)
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf_dir, duck, name):
    assert oracle.compare(QUERIES[name](spark, sf_dir), duck, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    rows = entry_point.entry(spark).collect()
    assert sorted(r["day_of_week"] for r in rows) == [1, 2, 3, 4, 5, 6, 7]
