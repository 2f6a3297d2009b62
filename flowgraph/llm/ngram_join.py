"""Jaccard join of documents on word n-grams by a token-group matrix.

A document is its set of distinct 5-word shingles, as 64-bit hashes. Equal sets fall into one class; from there on
one node stands for each class. Two nodes link when 100 * intersection >= 80 * union.

1. Shingles are ordered rare first: a fixed-width table of counts over all documents gives each shingle a level, and
   within a level the hash decides. Any order gives the same result; this one keeps passages that many documents
   share out of the way. Of their first n - ceil(0.8 n) + l shingles, l = n // 10 + 1, linked nodes share l or more:
   these, by shingle, are the postings.
2. Similar nodes are put into groups: a node goes to the node, of those that come first under one of its shingles, with
   which it shares most of them, if these are half the bound l or more and the sizes fit; a node that others go to leads
   a group of its own.
3. The token-group matrix holds each group's token union. A query node opens a group, its own included, only if their
   overlap reaches the bound l and a member's size fits. An opened group is compared by its lead first, which is linear
   in the groups opened; what links there is joined, so that thousands of near copies become one group.
4. The matrix is built anew over the joined groups, and a query node is compared with all members of a group it opens
   that reach the bound themselves. A shingle of more than LIGHT groups is left out, and the
   bound lowered by the number of such shingles that the node holds. A node for which that leaves nothing is full: it
   asks only other full nodes, with the whole bound, as those it shares a left-out shingle with are met in step 5.
5. Full nodes hold little but such shingles: many unlike variants of one text, or
   short texts around a common passage. Those that such shingles connect are cut into blocks of BLOCK_NODES, and each
   pair of blocks is compared whole by one product of its token matrices, which returns a spanning forest of its links.
6. Links of all rounds are joined into components.

No link between different sets is lost: a pair in one joined group needs no further test, and a linked pair in two groups
meets every condition of step 4, seen from one of its sides, or both its sides are full and share a left-out shingle,
which step 5 compares. What reaches the driver is the level table, LEVEL_CELLS counts, and a bounded filter for the
documents whose sets are read again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgraph.llm.common import bit_filter, checkpoint, delete, documents, fresh, fresh_dir, let_go, passes, slices, spot, stored, stored_at

WORDS = 5
PERCENT = 80
LEVEL_CELLS = 1 << 19
CHUNK = 1 << 14
LIGHT = 32
BLOCK_NODES = 512
LOCAL_EDGES = 1 << 17
BLOCK = 4 << 20

_U = np.uint64
_random = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _random.integers(1, 1 << 63, 256, dtype=_U) * _U(2) + _U(1)
_PLACE = _random.integers(1, 1 << 63, 64, dtype=_U) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _BYTE[_LOWER]
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a byte array and where they start."""
    blank = _BLANK[data]
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, _U), starts
    sizes = ends - starts
    power = np.cumprod(np.full(int(sizes.max()), _BASE, _U), dtype=_U)
    inside = np.flatnonzero(~blank)
    place = inside - np.repeat(starts, sizes)
    sums = np.add.reduceat(_BYTE[data[inside]] * power[place], np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    return _mix(sums + sizes.astype(_U) * _PLACE[63]), starts


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """The words of each text, lower-cased over A-Z, as hashes; long texts in blocks that end at a blank."""
    if sum(map(len, texts)) > BLOCK and len(texts) > 1:
        return [h for t in texts for h in word_hashes([t])]
    if len(texts) == 1 and len(texts[0]) > BLOCK:
        data, at, out = np.frombuffer(texts[0], np.uint8), 0, []
        while at < len(data):
            end = at + BLOCK
            while end < len(data) and not _BLANK[data[end]]:
                step = np.flatnonzero(_BLANK[data[end : end + BLOCK]])
                end += int(step[0]) if len(step) else BLOCK
            out.append(_word_hashes(data[at:end])[0])
            at = end
        return [np.concatenate(out)]
    hashes, starts = _word_hashes(np.frombuffer(b" ".join(texts), np.uint8))
    firsts = np.cumsum([0] + [len(t) + 1 for t in texts])
    return np.split(hashes, np.searchsorted(starts, firsts[1:-1]))


def shingles(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """The sorted distinct n-word shingles of a sequence of word hashes; a shorter sequence is one as a whole."""
    if not len(words):
        return words
    if len(words) < n:
        return _mix((words * _PLACE[: len(words)]).sum(keepdims=True) + _PLACE[57 + len(words)])
    total = words[: len(words) - n + 1] * _PLACE[0]
    for k in range(1, n):
        total = total + words[k : len(words) - n + 1 + k] * _PLACE[k]
    found = _mix(total)
    found.sort()
    return found[np.concatenate([[True], found[1:] != found[:-1]])]


def text_sets(texts: list[str], n: int = WORDS) -> list[np.ndarray]:
    return [shingles(w, n) for w in word_hashes([t.encode("utf-8", "surrogatepass") for t in texts])] if texts else []


def links(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two non-empty sorted sets link."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    same = int((b[at] == a).sum())
    return 100 * same >= percent * (len(a) + len(b) - same)


def _need(size: int, percent: int) -> int:
    """The least overlap of a set of this size with any set that it links to."""
    return -(-size * percent // 100)


def _bound(size, percent: int):
    """Of so many more first shingles than one, linked sets share as many."""
    return size // 10 + 1


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> _U(40)).astype(np.int64) & (LEVEL_CELLS - 1)


def _sketch(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        counts = np.zeros(LEVEL_CELLS, np.int64)
        for _, texts in slices(batches):
            if sets := text_sets(texts, n):
                counts += np.bincount(_cell(np.concatenate(sets)), minlength=LEVEL_CELLS)
        parts = counts.reshape(-1, CHUNK)
        spread = TaskContext.get().partitionId() % 64
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(len(parts)), pa.int32()), "spread": pa.array([spread] * len(parts), pa.int32()), "counts": [p.astype("<u4").tobytes() for p in np.minimum(parts, 0xFFFFFFFF)]})

    return run


def _sum_chunks(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(CHUNK, np.int64)
    for c in rows.counts:
        total += np.frombuffer(c, "<u4")
    return rows.head(1).assign(counts=[np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes()])


def levels(docs: DataFrame, n: int = WORDS) -> np.ndarray:
    """A level 0 to 31 for each cell of shingle hashes: how often, in powers of two, it is counted above the average."""
    shape = "chunk int, spread int, counts binary"
    parts = docs.select("text").mapInArrow(_sketch(n), shape)
    for keys in (["chunk", "spread"], ["chunk"]):
        parts = parts.groupBy(*keys).applyInPandas(_sum_chunks, shape)
    rows = sorted(parts.select("chunk", "counts").collect())
    counts = np.concatenate([np.frombuffer(r[1], "<u4") for r in rows]) if rows else np.zeros(LEVEL_CELLS)
    return np.minimum(np.log2(1 + counts / (counts.mean() + 8)).astype(np.uint8), 31)


def _setter(level, n: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        table = level.value
        for batch, texts in slices(batches):
            sizes, high, low, firsts = [], [], [], []
            for s in text_sets(texts, n):
                one, two = digest(s)
                order = np.argsort(table[_cell(s)], kind="stable")[: len(s) - _need(len(s), percent) + _bound(len(s), percent)]
                sizes.append(len(s))
                high.append(one)
                low.append(two)
                firsts.append(s[order].view(np.int64))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n": pa.array(sizes, pa.int64()), "d1": pa.array(high, pa.int64()), "d2": pa.array(low, pa.int64()), "firsts": pa.array(firsts, pa.list_(pa.int64()))})

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (token, node) in order: token, node and the token's least node, for tokens with several nodes."""
    last: tuple[int, int] | None = None
    told = False
    for batch in batches:
        token, node = (np.array(batch.column(c)) for c in ("token", "node"))
        if last:
            token, node = np.append(np.int64(last[0]), token), np.append(np.int64(last[1]), node)
        if not len(token):
            continue
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        sizes = np.diff(np.append(start, len(token)))
        center = np.repeat(node[start], sizes)
        keep = np.repeat(sizes > 1, sizes)
        if last and told:
            keep[0] = False
        if last is None or token[0] != token[-1] or not told:
            told = bool(sizes[-1] > 1)
        last = int(token[-1]), int(center[-1])
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (token, node, center)], ["token", "node", "center"])


def _checker(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = batch.column("set_a"), batch.column("set_b")
            good = [links(np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U), percent) for x, y in zip(one, two, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _resetter(n: int, bits) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sets of the documents that the filter lets through; few others, none missing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            inside = passes(bits.value, np.array(batch.column("spot")))
            for _, texts in slices([batch.filter(pa.array(inside))]):
                sets = [s for s in text_sets(texts, n) if len(s)]
                digests = [digest(s) for s in sets]
                yield pa.RecordBatch.from_pydict({"d1": pa.array([d[0] for d in digests], pa.int64()), "d2": pa.array([d[1] for d in digests], pa.int64()), "tokens": pa.array([s.tobytes() for s in sets], pa.binary())})

    return run


def _sets_of(docs: DataFrame, nodes: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """(node, tokens) of the given nodes, from the texts again."""
    wanted = checkpoint(nodes.distinct().join(classes, "node").select("node", "d1", "d2", spot("first_id").alias("spot")))
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted, wanted.count()))
    again = docs.select(spot("doc_id").alias("spot"), "text").mapInArrow(_resetter(n, bits), "d1 long, d2 long, tokens binary")
    return stored(again.join(wanted.select("node", "d1", "d2"), ["d1", "d2"]).dropDuplicates(["d1", "d2"]).select("node", "tokens"), "tokens")


def digest(s: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist())


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    size = F.octet_length("tokens")
    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("set_a"), size.alias("size_a")), "a")
    both = with_a.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("set_b"), size.alias("size_b")), "b")
    fits = (100 * F.col("size_a") >= percent * F.col("size_b")) & (100 * F.col("size_b") >= percent * F.col("size_a"))
    return both.where(fits).select("a", "b", "set_a", "set_b").mapInArrow(_checker(percent), "a long, b long")


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of edges (a, b), by one union-find; roots are the least nodes."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    found = [(x, r) for x in root if (r := find(x)) != x]
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["node", "root"])


def components(edges: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """(node, root) of the nodes of edges (a, b) that aren't their component's least node, which is the root.

    Up to `local` edges are one task's work. While there are more, each round hooks every node to its least
    neighbour, jumps to the roots by doubling, and keeps the edges that still join different roots.
    """
    put = lambda df: checkpoint(df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    edges, found = put(edges), None
    while edges.count() > local:
        up = checkpoint(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")))
        while True:
            above = up.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            jumped = checkpoint(up.join(above, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("_moved")))
            up = jumped.drop("_moved")
            if jumped.where("_moved").isEmpty():
                break
        found = up if found is None else checkpoint(_moved(found, up, "root").unionByName(up))
        edges = put(_moved(_moved(edges, up, "a"), up, "b"))
    rest = edges.coalesce(1).mapInArrow(_roots, "node long, root long")
    return checkpoint(rest if found is None else _moved(found, rest, "root").unionByName(rest))


def _moved(df: DataFrame, up: DataFrame, column: str) -> DataFrame:
    """df with the nodes in a column as their roots."""
    to = up.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    return df.join(to, F.col(column) == F.col("_n"), "left").withColumn(column, F.coalesce("_r", column)).drop("_n", "_r")


def _grouped(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows (node, ...) with the node's group, itself where it has none."""
    to = groups.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    return rows.join(to, F.col("node") == F.col("_n"), "left").withColumn("group", F.coalesce("_r", "node")).drop("_n", "_r")


def _groups(shared: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(node, root) of the nodes that go to another node's group, which leads it."""
    stars = shared.where("node <> center").groupBy("node", "center").agg(F.count("*").alias("c"))
    theirs = sizes.select(F.col("node").alias("center"), F.col("n").alias("size"))
    near = stars.join(sizes, "node").where(2 * F.col("c") >= _bound_of("n")).join(theirs, "center")
    near = near.where((100 * F.col("n") >= percent * F.col("size")) & (100 * F.col("size") >= percent * F.col("n")))
    best = checkpoint(near.groupBy("node").agg(F.max_by("center", F.struct("c", -F.col("center"))).alias("root")))
    return best.join(best.select(F.col("root").alias("node")), "node", "left_anti")


def _posts(shared: DataFrame, sizes: DataFrame, groups: DataFrame, percent: int, several: bool) -> DataFrame:
    """Postings of tokens, or of those that several groups hold: token, node, group, heavy, and the node's n, bound l, heavy tokens h.

    full: whether h reaches the bound that the node has with its smallest partners. asks: whether it isn't full, or its
    light tokens alone reach that bound; a full node that doesn't ask can't be found by another full node either.
    """
    posts = _grouped(shared.select("token", "node"), groups)
    held = posts.select("token", "group").distinct().groupBy("token").agg(F.count("*").alias("c"))
    posts = posts.join((held.where("c > 1") if several else held).select("token", (F.col("c") > LIGHT).alias("heavy")), "token")
    least = _bound_of(f"(n * {percent} + 99) div 100")
    own = posts.groupBy("node").agg(F.count_if("heavy").alias("h"), F.count_if(~F.col("heavy")).alias("light")).join(sizes, "node")
    own = own.select("node", "n", "h", _bound_of("n").alias("l"), (F.col("h") >= least).alias("full"), ((F.col("h") < least) | (F.col("light") >= least)).alias("asks"))
    return stored(posts.join(own, "node"), "posts")


def _asking(posts: DataFrame) -> DataFrame:
    left = F.when(F.col("full"), F.lit(0)).otherwise(F.col("h"))
    return posts.where("not heavy and asks").select("token", F.col("node").alias("q"), "group", F.col("n").alias("nq"), left.alias("h"), F.col("l").alias("lq"), F.col("full").alias("fq"))


def _fits(low: str, high: str, percent: int):
    return (100 * F.col(high) >= percent * F.col("nq")) & (percent * F.col(low) <= 100 * F.col("nq"))


def _opened(posts: DataFrame, percent: int) -> DataFrame:
    """(q, g): the groups that a node opens, by its overlap with their token unions, its own tokens apart.

    A node that isn't full asks all groups, and a full one the full ones, from which nothing is taken for heavy tokens.
    """
    matrix = posts.where("not heavy").groupBy("token", F.col("group").alias("g")).agg(
        F.count("*").alias("members"), F.min("n").alias("least"), F.max("n").alias("most"), F.min("l").alias("lg"), F.max(F.col("full") & F.col("asks")).alias("fg"),
    )
    others = (F.col("group") != F.col("g")) | (F.col("members") > 1)
    asked = _asking(posts).join(matrix, "token").where(others & _fits("least", "most", percent) & (~F.col("fq") | F.col("fg")))
    asked = asked.groupBy("q", "g", "nq", "h", "lq").agg(F.count("*").alias("light"), F.min("lg").alias("lg"))
    return asked.where(_reaches("lg")).select("q", "g")


def _leads(posts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a node and the lead of a group that it opens."""
    return _opened(posts, percent).where("q <> g").select(F.least("q", "g").alias("a"), F.greatest("q", "g").alias("b")).distinct()


def _candidates(posts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes in different groups, opened by one of them, that reach the bound on their overlap, unless both are full and share a heavy token."""
    theirs = posts.where("not heavy").select("token", F.col("node").alias("d"), F.col("group").alias("g"), F.col("n").alias("nd"), F.col("l").alias("ld"), (F.col("full") & F.col("asks")).alias("fd"))
    pairs = _asking(posts).join(_opened(posts, percent), "q").where(F.col("group") != F.col("g")).drop("group").join(theirs, ["token", "g"]).where(_fits("nd", "nd", percent) & (~F.col("fq") | F.col("fd")))
    pairs = pairs.groupBy("q", "d", "h", "lq", "ld").agg(F.count("*").alias("light"))
    return pairs.where(_reaches("ld")).select(F.least("q", "d").alias("a"), F.greatest("q", "d").alias("b")).distinct()


def _forest(size: int, one: np.ndarray, two: np.ndarray) -> list[tuple[int, int]]:
    """Of links between 0 ... size - 1 those that join what the ones before have not."""
    root = list(range(size))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for a, b in zip(one.tolist(), two.tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            root[y] = x
            out.append((a, b))
    return out


def linked_forest(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets, from the product of their token matrix with itself."""
    size = np.array([len(s) for s in sets])
    tokens, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(len(sets)), size), often[column] > 1
    number = np.cumsum(often > 1) - 1
    overlap = np.zeros((len(sets), len(sets)), np.float32)
    row, column = row[shared], number[column[shared]]
    step = 4096
    for first in range(0, int((often > 1).sum()), step):
        here = (column >= first) & (column < first + step)
        part = np.zeros((len(sets), step), np.float32)
        part[row[here], column[here] - first] = 1
        overlap += part @ part.T
    good = 100 * overlap >= percent * (size[:, None] + size[None, :] - overlap)
    return _forest(len(sets), *np.nonzero(np.triu(good, 1)))


def _block_links(percent: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        nodes = rows.node.to_numpy()
        found = linked_forest([np.frombuffer(t, _U) for t in rows.tokens], percent)
        return pd.DataFrame({"a": [nodes[x] for x, _ in found], "b": [nodes[y] for _, y in found]}, dtype=np.int64)

    return run


def _full_links(full: DataFrame, clusters: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join all full nodes of a cluster that are linked; full has node, clusters as from components."""
    placed = _grouped(full, clusters)
    blocks = placed.groupBy("group").agg(F.ceil(F.count("*") / BLOCK_NODES).cast("int").alias("k")).withColumnRenamed("group", "cluster")
    placed = placed.join(blocks, F.col("group") == F.col("cluster")).withColumn("i", F.pmod(F.xxhash64("node"), "k").cast("int"))
    with_sets = placed.join(sets, "node").select("cluster", "node", "tokens", "i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j"))
    return with_sets.groupBy("cluster", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y")).applyInPandas(_block_links(percent), "a long, b long")


def _bound_of(size: str):
    return F.expr(f"({size}) div 10 + 1")


def _reaches(other: str):
    """Whether the light shared shingles reach what the bound of both sides leaves for them."""
    return F.col("light") >= F.greatest(F.lit(1), F.least("lq", other) - F.col("h"))


def join(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and class_id (the smallest doc_id with an equal set) of each row of docs.

    docs has doc_id long and text string; other columns are ignored. Null, empty and blank texts have no shingles and
    are alone, whatever others there are: component_id is their own id. Each row is a document, also if rows are
    equal or share an id; a null id never is the smallest, so a component of null ids has the id null. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    level = spark.sparkContext.broadcast(levels(docs, n))
    sets = docs.mapInArrow(_setter(level, n, percent), "doc_id long, n long, d1 long, d2 long, firsts array<long>")
    at = fresh_dir(spark, "sets")
    whole = stored_at(sets.withColumn("row", F.monotonically_increasing_id()), at)
    sets = stored(whole.drop("firsts"), "documents")
    full = sets.where("n > 0")
    classes = checkpoint(full.groupBy("d1", "d2").agg(F.min("row").alias("node"), F.min("doc_id").alias("class_id"), F.min_by("doc_id", "row").alias("first_id")))
    nodes = whole.select(F.col("row").alias("node"), "firsts").join(classes.select("node"), "node", "left_semi")
    posts = nodes.select("node", F.explode("firsts").alias("token")).repartition("token").sortWithinPartitions("token", "node")
    shared = stored(posts.mapInArrow(_stars, "token long, node long, center long"), "shared")
    delete(spark, at)

    sizes = full.select(F.col("row").alias("node"), "n")
    both = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("node"))
    leads = checkpoint(_leads(_posts(shared, sizes, _groups(shared, sizes, percent), percent, several=False), percent))
    edges = checkpoint(verified(leads, _sets_of(docs, both(leads), classes, n), percent))
    groups = components(edges)
    posts = _posts(shared, sizes, groups, percent, several=True)
    pairs = checkpoint(_candidates(posts, percent))
    crowd = posts.where("full and heavy")
    hubs = crowd.groupBy("token").agg(F.min("node").alias("b"))
    clusters = components(crowd.select("token", F.col("node").alias("a")).join(hubs, "token").select("a", "b"))
    packed = checkpoint(crowd.select("node").distinct())
    again = _sets_of(docs, both(pairs).unionByName(packed), classes, n)
    more = checkpoint(verified(pairs, again, percent).unionByName(_full_links(packed, clusters, again, percent)))
    if not more.isEmpty():
        groups = components(edges.unionByName(more))
    labelled = _grouped(classes, groups)
    low = labelled.groupBy("group").agg(F.min("class_id").alias("component_id"))
    named = labelled.join(low, "group").select("d1", "d2", "class_id", "component_id")
    out = full.select("doc_id", "n", "d1", "d2").join(named, ["d1", "d2"]).select("doc_id", "n", "component_id", "class_id")
    alone = sets.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"))
    return out.unionByName(alone).withColumnRenamed("n", "n_shingles")


def keep_one(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs, all columns, with one row of each component: that of the smallest doc_id, or any one if ids repeat.

    Rows without a word are all kept, as each is alone.
    """
    unique = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty()
    row = fresh("_row", docs)
    rows = docs.withColumn(row, F.col("doc_id") if unique else F.monotonically_increasing_id())
    rows = rows if unique else stored(rows, "rows")
    found = join(rows.select(F.col(row).alias("doc_id"), "text"), n, percent)
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias(row))
    return rows.join(kept, row, "left_semi").select(*[rows[c] for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir))
