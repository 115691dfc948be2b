from __future__ import annotations

import pytest

from quillgraph.plans import graph_queries, problems, service_queries

from .compare import check


@pytest.mark.parametrize("name", list(graph_queries.QUERIES))
def test_graph_query(spark, small, name):
    check(spark, small, graph_queries, name)


@pytest.mark.parametrize("name", list(service_queries.QUERIES))
def test_service_query(spark, small, name):
    check(spark, small, service_queries, name)


@pytest.mark.parametrize("name", list(problems.QUERIES))
def test_problem_query(spark, small, name):
    check(spark, small, problems, name)


def test_entry_contract(spark, small):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["id", "rank"]
