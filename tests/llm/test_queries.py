from __future__ import annotations

import pytest

from quillgraph.llm import queries

from ..compare import check


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, small, name):
    check(spark, small, queries, name)
