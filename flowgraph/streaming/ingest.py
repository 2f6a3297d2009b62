"""Artifacts that arrive bit by bit: each micro-batch is a load that replaces the rows of its keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgraph.operators.rows import upsert


def append_loads(stream: DataFrame, path: str, checkpoint: str):
    """Writes each micro-batch to its own folder `load=<number>`, over what a failed try has left; starts the stream."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/load={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def current(spark, path: str, keys: list[str]) -> DataFrame:
    """The last row of each key over all loads."""
    return upsert(spark.read.parquet(path).withColumn("load_ord", F.col("load").cast("long")).drop("load"), keys).drop("load_ord")
