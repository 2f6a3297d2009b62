"""Benchmark decontamination by pigeonhole edit matching.

A test item may differ from a passage in a document by a budget of k edits, ERROR_RATE of its length. Cut into k + 1
pieces, at least one piece must stand in the passage unchanged. All pieces of all items go into one automaton that
finds their exact hits in one run over a document; around each hit the item is verified by Myers' bit-parallel
distance, with both ends of the passage free. Texts are compared in lower case with runs of blanks as one blank.
Items under MIN_CHARS are held only unchanged and as whole words.

Items are taken in blocks of BLOCK_CHARS characters: a worker holds one block's automaton at a time. Documents are read
once, whatever the number of blocks: a task looks for one block after the other in each HELD_BYTES of its texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from flowgraph.llm.common import documents, kept, read, slices

ERROR_RATE = 0.05
#: Shorter items have no budget: a few edits, or a part of a word, match by chance.
MIN_CHARS = 32
BLOCK_CHARS = 2_000_000
HELD_BYTES = 32 << 20
Blocks = list  # of broadcast blocks
HITS = "doc_id long, item_id long, edits int, item_chars int, start long"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(length: int, rate: float = ERROR_RATE) -> int:
    return int(length * rate)


def pieces(text: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly one length, with their places."""
    cuts = [len(text) * i // (k + 1) for i in range(k + 2)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def whole(text: str, start: int, end: int) -> bool:
    """Whether the passage neither begins nor ends inside a run of letters and digits."""
    inside = lambda at: 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum()
    return not inside(start) and not inside(end)


class Pattern:
    """An item, its budget and its bit masks by character."""

    def __init__(self, item_id: int, text: str, rate: float) -> None:
        self.item_id, self.text, self.short = item_id, text, len(text) < MIN_CHARS
        self.k = 0 if self.short else budget(len(text), rate)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """The least distance of the item to any substring of text, and where the first such substring ends."""
        m, masks = len(self.text), self.masks
        full, high = (1 << m) - 1, 1 << (m - 1)
        up, down, score, least, end = full, 0, m, m, 0
        for at, c in enumerate(text, 1):
            eq = masks.get(c, 0)
            x = eq | down
            h = (((eq & up) + up) ^ up) | eq
            plus, minus = down | (full & ~(h | up)), up & h
            if plus & high:
                score += 1
            elif minus & high:
                score -= 1
                if score < least:
                    least, end = score, at
            plus, minus = (plus << 1) & full, (minus << 1) & full
            up, down = minus | (full & ~(x | plus)), plus & x
        return least, end


class Matcher:
    def __init__(self, items: tuple[tuple[int, str], ...], rate: float) -> None:
        self.patterns = [Pattern(i, t, rate) for i, t in items]
        found: dict[str, list[tuple[int, int]]] = {}
        for n, p in enumerate(self.patterns):
            for place, piece in pieces(p.text, p.k):
                found.setdefault(piece, []).append((n, place))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, edits, item's length, start) for each item that text holds within its budget."""
        text, starts = normal(text), {}
        if not self.patterns or not text:
            return []
        for end, (size, where) in self.automaton.iter(text):
            for n, place in where:
                starts.setdefault(n, set()).add(end + 1 - size - place)
        out = []
        for n, places in starts.items():
            p = self.patterns[n]
            if hit := self._verify(p, text, sorted(places)):
                out.append((p.item_id, hit[0], len(p.text), hit[1]))
        return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0))

    @staticmethod
    def _verify(p: Pattern, text: str, places: list[int]) -> tuple[int, int] | None:
        m, best = len(p.text), None
        for s in places:
            if s >= 0 and text.startswith(p.text, s) and (not p.short or whole(text, s, s + m)):
                return 0, s
        if p.short:
            return None
        spans: list[list[int]] = []
        for s in places:
            a, b = max(0, s - p.k), min(len(text), s + m + p.k)
            if spans and a <= spans[-1][1]:
                spans[-1][1] = b
            else:
                spans.append([a, b])
        for a, b in spans:
            edits, end = p.best(text[a:b])
            if edits <= p.k and (best is None or edits < best[0]):
                best = edits, max(0, a + end - m)
        return best


def matcher(items: tuple[tuple[int, str], ...], rate: float) -> Matcher:
    """The last block's automaton lives on from task to task."""
    return kept(Matcher, items, rate)


def blocks(benchmark: DataFrame, limit: int = BLOCK_CHARS) -> Iterator[tuple[tuple[int, str], ...]]:
    """The benchmark's usable items, normalised, in blocks; only a block at a time is on the driver."""
    block: list[tuple[int, str]] = []
    size = 0
    for item_id, text in benchmark.select("item_id", "text").toLocalIterator():
        text = normal(text)
        if not text:
            continue
        if block and size + len(text) > limit:
            yield tuple(block)
            block, size = [], 0
        block.append((item_id, text))
        size += len(text)
    if block:
        yield tuple(block)


def _searched(batches: Iterator[pa.RecordBatch], found: Blocks, rate: float) -> Iterator[tuple[pa.RecordBatch, list[list]]]:
    """Batches with what each of their texts holds of all blocks."""

    def search(held: list[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list]]]:
        out = [[[] for _ in range(len(b))] for b in held]
        for block in found:
            find = matcher(block.value, rate).find
            for batch, hits in zip(held, out, strict=True):
                at = 0
                for _, texts in slices([batch]):
                    for text in texts:
                        hits[at] += find(text)
                        at += 1
        return zip(held, out, strict=True)

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= HELD_BYTES or len(found) == 1:
            yield from search(held)
            held, size = [], 0
    yield from search(held)


def _finder(found: Blocks, rate: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, hits in _searched(batches, found, rate):
            rows = [(d, *hit) for d, own in zip(batch.column("doc_id").to_pylist(), hits, strict=True) for hit in own]
            if rows:
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in HITS.split(", ")])

    return run


def _dropper(found: Blocks, rate: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, hits in _searched(batches, found, rate):
            yield batch.filter(pa.array([not own for own in hits], pa.bool_()))

    return run


def hits(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, limit: int = BLOCK_CHARS) -> DataFrame:
    """A row per document and item that it holds: doc_id, item_id, edits, item_chars, start in the normalised text.

    Null and empty texts hold nothing; items under MIN_CHARS characters are held as whole words without edits; equal items are reported
    each; repeated documents each get their rows; the start is that of the best passage, the first of equals, exact
    for edits = 0 and else at most `edits` characters off. Empty tables give no rows; other columns are ignored.
    """
    return docs.select("doc_id", "text").mapInArrow(_finder(_sent(docs, benchmark, limit), rate), HITS)


def _sent(docs: DataFrame, benchmark: DataFrame, limit: int) -> Blocks:
    sc = docs.sparkSession.sparkContext
    return [sc.broadcast(block) for block in blocks(benchmark, limit)]


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, limit: int = BLOCK_CHARS) -> DataFrame:
    """docs, all columns, without those that hold an item; needs a text column."""
    return docs.mapInArrow(_dropper(_sent(docs, benchmark, limit), rate), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(documents(spark, sf_dir), read(spark, sf_dir, "benchmark"))
