"""The queries that SQL can express, side by side with DuckDB on the smallest tables."""

import pytest

from checks.compare import database, rows
from cinderlog.llm.queries import LLM_ORACLES, LLM_QUERIES


@pytest.mark.parametrize("name", list(LLM_ORACLES))
def test_query_and_statement(spark, sf, name):
    ours = LLM_QUERIES[name](spark, sf)
    result = database(sf).execute(LLM_ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(ours.columns)
    assert rows(ours.columns, ours.collect()) == rows(columns, result.fetchall())


def test_statements_belong_to_queries():
    assert set(LLM_ORACLES) <= set(LLM_QUERIES)
