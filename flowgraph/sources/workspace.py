"""The folder that all executors share, for results that end a lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset and the master is local."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            found = tempfile.mkdtemp(prefix="flowgraph-")
            atexit.register(shutil.rmtree, found, True)
        sc.setCheckpointDir(found)
    return sc.getCheckpointDir()


def fresh_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder there."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """df computed once, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
