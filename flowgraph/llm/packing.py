"""Packing into fixed-length sequences by bounded-space online best-fit.

Each partition keeps at most OPEN_WINDOWS windows open. A document's whole windows close at once; what remains goes
to the open window that it fills best. When it fits in none, and no more may be opened, the fullest window is
emitted. What is open at a partition's end is merged in rounds: FAN partitions at a time, the windows themselves are
placed the same way, fullest first, until one group is left and everything is emitted. A round's group holds FAN *
OPEN_WINDOWS windows at most, whatever the input.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgraph.llm import bpe
from flowgraph.llm.common import checkpoint, documents, slices

END_ID = 1
LENGTH = 2048
OPEN_WINDOWS = 64
FAN = 16

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open_used long"
MOVES = "window long, sequence_id long, base long, used long, _group long, closed boolean"


class Windows:
    """The open windows of one partition; items are anything, sizes 1 to length."""

    def __init__(self, length: int, most: int) -> None:
        self.length, self.most = length, most
        self.by_free: list[tuple[int, int]] = []
        self.held: dict[int, list] = {}

    def place(self, size: int, item: object, name: Callable[[], int]) -> Iterator[tuple[int, int, list]]:
        """Places item; yields (window, used, [(item, offset)]) of each window that is emitted."""
        at = bisect.bisect_left(self.by_free, (size, -1))
        if at < len(self.by_free):
            free, window = self.by_free.pop(at)
        else:
            if len(self.by_free) >= self.most:
                yield self._emit(*self.by_free.pop(0))
            free, window = self.length, name()
            self.held[window] = []
        self.held[window].append((item, self.length - free))
        if free == size:
            yield self._emit(0, window)
        else:
            bisect.insort(self.by_free, (free - size, window))

    def _emit(self, free: int, window: int) -> tuple[int, int, list]:
        return window, self.length - free, self.held.pop(window)

    def rest(self) -> Iterator[tuple[int, int, list]]:
        while self.by_free:
            yield self._emit(*self.by_free.pop(0))


def _packer(path: str, length: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, windows, n = bpe.encoder(path), Windows(length, most), TaskContext.get().partitionId() << 32
        out: list[tuple] = []

        def name() -> int:
            nonlocal n
            n += 1
            return n - 1

        def emit(window: int, items: list, used: int = 0) -> None:
            out.extend((*piece, window, offset, used) for piece, offset in items)

        for batch, texts in slices(batches, bpe.SLICE):
            ids, counts = encoder.encode(texts)
            end = 0
            for doc_id, count in zip(batch.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                own = np.append(ids[end : end + count], np.uint32(END_ID)).astype("<u4")
                end += count
                for start in range(0, len(own), length):
                    piece = own[start : start + length]
                    row = (doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(own))
                    for window, _, items in windows.place(len(piece), row, name):
                        emit(window, items)
            if len(out) >= 10_000:
                yield _rows(out)
                out = []
        for window, used, items in windows.rest():
            emit(window, items, used)
        if out:
            yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names)


def _merger(length: int, most: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A row is a partition's window inside a merged one (sequence_id, at base); used is the merged one's fill."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        windows, moved = Windows(length, most), {}
        whole = rows.groupby("sequence_id").used.first().reset_index().sort_values(["used", "sequence_id"], ascending=[False, True])

        def note(window: int, used: int, items: list, closed: bool) -> None:
            moved.update({old: (window, offset, used, closed) for old, offset in items})

        for old, used in zip(whole.sequence_id.tolist(), whole.used.tolist(), strict=True):
            for window, full, items in windows.place(used, old, lambda old=old: old):
                note(window, full, items, True)
        for window, used, items in windows.rest():
            note(window, used, items, last)
        to = [moved[x] for x in rows.sequence_id.tolist()]
        return rows.assign(sequence_id=[x[0] for x in to], base=rows.base + [x[1] for x in to], used=[x[2] for x in to], closed=[x[3] for x in to])

    return run


def pack(docs: DataFrame, path: str, length: int = LENGTH, most: int = OPEN_WINDOWS, fan: int = FAN) -> DataFrame:
    """Packs docs (doc_id long, text string); a row per piece, as PIECES without open_used.

    A document is its ids and END_ID, so a null or empty text has one token. Documents longer than a sequence are cut
    every `length` ids. Repeated rows and ids, null ids and ties are packed like any other row; other columns are
    ignored; an empty table gives no rows. sequence_id is unique but not gapless.
    """
    shape = PIECES.rpartition(",")[0]
    names = [x.split()[0] for x in shape.split(", ")]
    pieces = checkpoint(docs.select("doc_id", "text").mapInArrow(_packer(path, length, most), PIECES))
    left = pieces.where("open_used > 0")
    moves = left.groupBy(F.col("sequence_id").alias("window")).agg(F.max("open_used").alias("used"))
    moves = moves.select("window", F.col("window").alias("sequence_id"), F.lit(0).cast("long").alias("base"), "used", F.shiftright("window", 32).alias("_group"), F.lit(False).alias("closed"))
    groups = (moves.agg(F.max("_group")).first()[0] or 0) + 1
    done = None
    while True:
        last = groups <= fan
        step = moves.withColumn("_group", F.expr(f"_group div {fan}")).groupBy("_group").applyInPandas(_merger(length, most, last), MOVES)
        step = checkpoint(step)
        done = step.where("closed") if done is None else done.unionByName(step.where("closed"))
        if last:
            break
        moves, groups = step.where("not closed"), -(-groups // fan)
    ready = pieces.where("open_used = 0").select(*names)
    to = done.select("window", F.col("sequence_id").alias("_to"), "base")
    merged = left.join(to, left.sequence_id == to.window).select(*names[:5], F.col("_to").alias("sequence_id"), (F.col("offset") + F.col("base")).alias("offset"))
    return ready.unionByName(merged)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), bpe.default_path())
