"""Rows computed once and kept where every executor can read them again."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_checkpoints(spark: SparkSession) -> None:
    """Make sure that checkpoint() has a folder: the cluster's spark.checkpoint.dir, or on a single machine a temporary one.

    On a cluster a folder must be named: a machine's own folder can't be read by the others.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="spark-checkpoints-")
        atexit.register(shutil.rmtree, where, True)
    sc.setCheckpointDir(where)


def scratch_folder(spark: SparkSession) -> str:
    """A new path in the shared checkpoint folder, for tables that a query writes and reads again."""
    shared_checkpoints(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"


def pinned(df: DataFrame) -> DataFrame:
    """The rows of df, computed once, in the shared checkpoint folder: lost executors cannot take them along."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint()
