"""What the training-data operators share: inputs, the shared folder, text batches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents are handed to Python code in slices of about this many characters.
SLICE_CHARS = 1_000_000
#: The most bits of a filter that goes to all tasks.
FILTER_BITS = 1 << 28


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(*(columns or ("doc_id", "text")))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, where it is unset, a temporary one in local mode alone (tests)."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="flowgraph-")
        atexit.register(shutil.rmtree, found.removeprefix("file://"), True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage at files in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, for results that are read more than once with few columns."""
    return stored_at(df, fresh_dir(df.sparkSession, name))


def stored_at(df: DataFrame, path: str) -> DataFrame:
    """df as a Parquet table at this path.

    The shuffle files that went into it are of no more use. Spark deletes them once the driver has collected the objects
    that stand for them, which it else does half an hour later.
    """
    df.write.parquet(path)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a stored table that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def slices(batches: Iterable[pa.RecordBatch], limit: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The rows of the batches with their texts (null: empty), in slices of about limit bytes; only a slice is Python strings."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(ends):
            before = int(ends[start - 1]) if start else 0
            stop = min(len(ends), int(np.searchsorted(ends, before + limit)) + 1)
            part = batch.slice(start, stop - start)
            yield part, [x or "" for x in part.column("text").to_pylist()]
            start = stop
    trim()


_kept: dict[tuple, object] = {}


def kept(make: Callable, *key):
    """make(*key), which lives on in a Python worker from task to task until another is asked for, so one at most is there."""
    at = (make, *key)
    if at not in _kept:
        let_go()
        _kept[at] = make(*key)
    return _kept[at]


def let_go() -> None:
    """Drops what an operator before kept in this worker."""
    _kept.clear()
    trim()


def trim() -> None:
    """Gives freed memory back to the system where it can be told to: idle workers stay beside those at work."""
    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give(0)


def fresh(name: str, df: DataFrame) -> str:
    """A column name like this one that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spot(*columns: str) -> Column:
    """Where a filter looks for these columns' values."""
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << 62) - 1))


def bit_filter(rows: DataFrame, n: int, most: int = FILTER_BITS) -> np.ndarray:
    """A filter over the spots (a column) of about n rows: bits in 64-bit words, 16 a row but `most` at most.

    Whatever is in rows passes it; as rows outgrow it, more of the others do.
    """
    size = min(most, max(1 << 16, 1 << (16 * n).bit_length()))
    word, bit = F.expr(f"shiftright(spot % {size}, 6)"), F.expr(f"shiftleft(1L, cast(spot % 64 as int))")
    words = rows.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(size // 64, np.uint64)
    bits[words.word.to_numpy(np.int64)] = words.bits.to_numpy(np.int64).view(np.uint64)
    return bits


def passes(bits: np.ndarray, spots: np.ndarray) -> np.ndarray:
    at = spots % (64 * len(bits))
    return (bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: str):
    """The column as UTF-8 bytes, null as none."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")
