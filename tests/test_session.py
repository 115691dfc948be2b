from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from quillgraph import session as S


def test_materialised_tables_can_be_released(spark):
    df, n = S.materialize_counted(spark.range(7).withColumn("x", F.lit(None).cast("string")), "t")
    assert n == 7 and df.count() == 7 and df.columns == ["id", "x"]
    home = S._own_dir(spark).removeprefix("file://")
    assert os.path.isdir(home)
    S.release(spark)
    assert not os.path.exists(home)
    assert S.materialize(spark.range(2), "t").count() == 2


class Context:
    master, applicationId = "spark://host:7077", "app-1"
    getCheckpointDir = staticmethod(lambda: None)


class Session:
    sparkContext = Context()

    def __init__(self, **conf):
        self.conf = {k.replace("_", "."): v for k, v in conf.items()}


def test_the_named_folder_is_used():
    session = Session(spark_checkpoint_dir="hdfs://x/shared/")
    assert S.shared_dir(session) == "hdfs://x/shared"
    assert S.work_path(session, "t").startswith("hdfs://x/shared/app-1/t-")


def test_no_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError):
        S.shared_dir(Session())
