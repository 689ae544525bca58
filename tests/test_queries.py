"""Every registered query against its DuckDB statement on the smallest tables."""

from pathlib import Path

import pytest

from checks.compare import database, difference
from checks.oracles import ORACLES
from cinderlog.plans.catalog import QUERIES

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not Path(TABLES).exists():
        pytest.skip("no driver tables")
    return database(TABLES)


def test_every_statement_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    problem, _ = difference(spark, con, TABLES, name)
    assert problem is None
