from __future__ import annotations

import os

import pytest

from quillgraph.session import build_session

DATA = os.environ.get("QUILLGRAPH_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    few = {"spark.default.parallelism": "2", "spark.sql.files.minPartitionNum": "2"}
    session = build_session("tests", 4, shuffle_partitions="2", driver_memory="4g", **few)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    path = f"{DATA}/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    return path
