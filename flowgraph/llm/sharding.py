"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns VNODES points on a ring of 64-bit hashes, each point owns the arc that ends at it, and a document
belongs to the arc of its hash. A shard takes as many documents as its load bound allows; those beyond it continue
clockwise to the next arc whose shard has room. The bounds are n // shards or one more, so counts are at most one
apart (law `rows`), and only the overflow of full shards leaves its own arc.

Positions are a grid of GRID steps. The overflow needs only the number of documents per step, so the ring is walked
on the driver over GRID counts, however many documents there are. The walk gives each step a few runs of ranks
(first, last, shard, slot), and every document finds its shard and slot from its rank in its step.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowgraph.llm.common import documents, fresh, utf8

VNODES = 64
GRID_BITS = 16
GRID = 1 << GRID_BITS


def ring(shards: int, vnodes: int = VNODES) -> list[int]:
    """The shard that owns each step of the grid: that of the first virtual node at or after it."""
    points: dict[int, int] = {}
    for shard in range(shards):
        for k in range(vnodes):
            points.setdefault(xxhash.xxh64_intdigest(f"shard-{shard}/{k}", seed=7) >> (64 - GRID_BITS), shard)
    owners, owner = [0] * GRID, points[min(points)]
    for step in range(GRID - 1, -1, -1):
        owner = points.get(step, owner)
        owners[step] = owner
    return owners


def walk(owners: list[int], counts: dict[int, int], bounds: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Runs (step, first rank, last rank + 1, shard, first slot) for documents per step and the shards' load bounds.

    First each step's own shard takes what fits, lowest ranks first; then the overflow goes round the ring, oldest first.
    """
    room, taken, runs, over = list(bounds), [0] * len(bounds), [], {}

    def place(step: int, first: int, n: int, shard: int) -> None:
        runs.append((step, first, first + n, shard, taken[shard]))
        taken[shard] += n
        room[shard] -= n

    for step, n in sorted(counts.items()):
        own = min(n, room[owners[step]])
        if own:
            place(step, 0, own, owners[step])
        if own < n:
            over[step] = (own, n - own)
    queue: deque[tuple[int, int, int]] = deque()
    for turn in range(2 * len(owners)):
        step = turn % len(owners)
        while queue and room[owners[step]]:
            source, first, n = queue.popleft()
            fit = min(n, room[owners[step]])
            place(source, first, fit, owners[step])
            if fit < n:
                queue.appendleft((source, first + fit, n - fit))
        if turn < len(owners) and step in over:
            queue.append((step, *over[step]))
    return runs


def assign(docs: DataFrame, shards: int = 24, vnodes: int = VNODES) -> DataFrame:
    """docs with shard int and slot long, gapless from 0 in each shard, in place of columns so named.

    A document's place on the ring is a hash of all its columns, nulls included, so repeated ids don't gather on one
    step; wholly equal rows take their places in any order, which gives the same table. An empty table gives no rows.
    Fewer documents than shards leave shards empty.
    """
    docs = docs.drop("shard", "slot")
    spark, columns = docs.sparkSession, [F.col(f"`{c}`") for c in docs.columns]
    step, rank, first, last, shard, base = (fresh(c, docs) for c in ("_step", "_rank", "_first", "_last", "_shard", "_base"))
    owners = ring(shards, vnodes)
    place = F.shiftrightunsigned(F.xxhash64(*columns), 64 - GRID_BITS).cast("int")
    #: GRID counts at most come to the driver.
    counts = {r[0]: r[1] for r in docs.select(place.alias(step)).groupBy(step).agg(F.count("*")).collect()}
    total = sum(counts.values())
    bounds = [total // shards + (s < total % shards) for s in range(shards)]
    names = (step, first, last, shard, base)
    values = list(zip(*walk(owners, counts, bounds), strict=True)) or [()] * len(names)
    runs = spark.createDataFrame(pa.table({n: pa.array(v, pa.int32() if n in (step, shard) else pa.int64()) for n, v in zip(names, values, strict=True)}))
    ranked = docs.withColumn(step, place).withColumn(rank, F.row_number().over(Window.partitionBy(step).orderBy(*columns)) - 1)
    #: One run a step and one more for each of the shards that fills up: the input's size doesn't raise that bound.
    joined = ranked.join(F.broadcast(runs), step).where((F.col(rank) >= F.col(first)) & (F.col(rank) < F.col(last)))
    return joined.select(*columns, F.col(shard).alias("shard"), (F.col(base) + F.col(rank) - F.col(first)).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 24) -> None:
    """All columns of docs as Parquet, a folder per shard, in slot order within each file."""
    assign(docs, shards).repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", (F.octet_length(utf8("text")) + 8).cast("long").alias("size"), F.crc32(utf8("text")).alias("text_crc32"))
    return assign(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
