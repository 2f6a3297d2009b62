"""Exact substring dedup with suffix arrays of shards.

Every byte that a LENGTH-byte string covers is removed if that string also starts earlier, in document order. Equal
strings have to meet in one shard, though a corpus of them fits nowhere. So:

1. Each LENGTH-byte window has an anchor, the least of the hashes of its GRAM-byte strings. It depends on the window
   alone, so equal windows have equal anchors. Windows with one anchor are neighbours: a stretch of starts.
2. Stretches are shuffled by anchor, as hashes, which tell who has a partner: an equal stretch, or one that agrees
   around the anchor (an equal window agrees on half of its other bytes to its left or to its right). The others hold
   no repeat. A map task that holds more than KEEP copies of a stretch reports the rest as covered itself, after it has
   compared their bytes with the first, so that a passage that a third of all documents share doesn't flood a shard.
3. The bytes of stretches with partners go to shards by anchor. Of equal ones a shard, too, sorts the first KEEP + 1 only
   and reports the rest, by their bytes. It builds its suffix array by induced sorting and
   its permuted common prefixes (induced.py); runs of suffixes that share LENGTH bytes are equal windows, and all but
   the earliest are covered. Hashes only choose what a shard reads; bytes decide.
4. Each document cuts out the union of what is covered.

For steps 3 and 4 only documents with a partnered or covered stretch are shuffled, by way of bounded filters. The shard
of an anchor holds that anchor's surroundings, of equal ones at most KEEP + 1 a flush of a map task; no other group is
gathered in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowgraph.llm.common import bit_filter, documents, passes, shuffle_partitions, slices, spot, stored, utf8
from flowgraph.llm.induced import common_prefixes, suffix_array

LENGTH = 100
GRAM = 24
#: Any window holds one of the MARKS strings of LENGTH - SHIFT bytes that begin 0, SHIFT, 2 * SHIFT ... before its anchor.
MARKS = 4
SHIFT = (LENGTH - GRAM) // MARKS
BLOCK = 1 << 18
#: Stretches in which a map task looks for copies, how many copies of one it lets through, and bytes of a suffix array.
HELD = 100_000
KEEP = 1
SHARD = 1 << 19
#: Cells of anchors to each shuffle partition: a task works on one after the other.
CELLS = 4
NULL_ID = -(1 << 63)

_U = np.uint64
_random = np.random.Generator(np.random.PCG64(1406))
_VALUE = _random.integers(1, 1 << 63, 256, dtype=_U) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _power(k: int, base: int = _BASE) -> np.uint64:
    return _U(pow(base, k, 1 << 64))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-byte strings, by doubling."""
    have, sums = {1: _VALUE[data]}, 1
    while 2 * sums <= GRAM:
        h = have[sums]
        have[2 * sums] = h[:-sums] + h[sums:] * _power(sums)
        sums *= 2
    out, size = have[sums], sums
    while size < GRAM:
        sums //= 2
        if size + sums <= GRAM:
            n = len(data) - size - sums + 1
            out = out[:n] + have[sums][size : size + n] * _power(size)
            size += sums
    return _mix(out)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def stretches(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts put together, that end at `ends`: the stretches of window starts with one anchor, as arrays.

    anchor (its hash), content (hash of all the stretch's bytes), text, start, end: bytes of the text that it covers,
    marks: for each of MARKS strings around the anchor a byte, 1 to 255, or 0 if the stretch doesn't hold it.
    """
    none = tuple(np.zeros(0, t) for t in (_U, _U, *[np.int64] * 4))
    if len(data) < LENGTH:
        return none
    hashes = _gram_hashes(data)
    #: The same bits for every block, so that a window's anchor never depends on what stands beside it.
    bits = _U(max(BLOCK, len(hashes)).bit_length())
    order = (hashes >> bits << bits) | np.arange(len(hashes), dtype=_U)
    spot = (_least(order, LENGTH - GRAM + 1) & ((_U(1) << bits) - _U(1))).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    sizes = np.maximum(ends - starts - LENGTH + 1, 0)
    text = np.repeat(np.arange(len(ends)), sizes)
    if not len(text):
        return none
    window = np.arange(len(text)) + np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    spot = spot[window]
    first = np.flatnonzero(np.concatenate([[True], (spot[1:] != spot[:-1]) | (text[1:] != text[:-1])]))
    last = np.append(first[1:], len(window)) - 1
    begin, end, text = window[first], window[last] + LENGTH, text[first]
    #: A stretch's hash is a difference of running sums, moved back to place 0.
    powers, inverse = _powers(len(data))
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(_VALUE[data] * powers, dtype=_U)])
    content = _mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(_U))
    spot = spot[first]

    marks = np.zeros(len(spot), np.int64)
    for k in range(MARKS):
        a, b = spot - k * SHIFT, spot + (LENGTH - SHIFT - k * SHIFT)
        there = (a >= begin) & (b <= end)
        a, b = np.where(there, a, 0), np.where(there, b, 0)
        marks = marks << 8 | np.where(there, _mix((sums[b] - sums[a]) * inverse[a]) % _U(255) + _U(1), _U(0)).astype(np.int64)
    #: Least hashes are small; mixed once more they spread over all cells.
    return _mix(hashes[spot] ^ _U(_BASE)), content, text, begin - starts[text], end - starts[text], marks


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(BLOCK, n)
    if size not in _POWERS:
        _POWERS.clear()
        _POWERS[size] = tuple(np.concatenate([np.ones(1, _U), np.cumprod(np.full(size, b, _U), dtype=_U)]) for b in (_BASE, _BASE_INVERSE))
    return tuple(p[:n] if k == 0 else p for k, p in enumerate(_POWERS[size]))


def _text_blocks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Joined bytes with their ends, the number of each one's text, and where in it they start.

    A text beyond BLOCK comes in parts that overlap so that each window stands whole in one.
    """
    parts, size = [], 0
    for k, t in enumerate(texts):
        step = BLOCK - LENGTH + 1
        for at in range(0, max(1, len(t) - LENGTH + 1), step):
            part = t[at : at + BLOCK] if len(t) > BLOCK else t
            if size + len(part) > BLOCK and parts:
                yield _joined(parts)
                parts, size = [], 0
            parts.append((k, at, part))
            size += len(part)
    if parts:
        yield _joined(parts)


def _joined(parts: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(p for *_, p in parts), np.uint8)
    return data, np.cumsum([len(p) for *_, p in parts]), np.array([k for k, *_ in parts]), np.array([a for _, a, _ in parts])


FIELDS = ("anchor", "content", "doc", "tie", "start", "end", "marks")


def _packed(rows: dict[str, np.ndarray]) -> bytes:
    """Rows as bytes, place by place of the numbers, so that what is alike stands together."""
    place = rows["start"] << 8 | (rows["end"] - rows["start"])
    numbers = np.stack([*(rows[c].view(np.int64) for c in FIELDS[:4]), place, rows["marks"]])
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), -1, 8).transpose(0, 2, 1)).tobytes()


def _unpacked(blobs: list[bytes]) -> dict[str, np.ndarray]:
    parts = [np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(6, 8, -1).transpose(0, 2, 1)).view(np.int64)[..., 0] for b in blobs]
    numbers = np.concatenate(parts, axis=1)
    start = numbers[4] >> 8
    return dict(zip(FIELDS, (numbers[0].view(_U), numbers[1].view(_U), *numbers[2:4], start, start + (numbers[4] & 255), numbers[5]), strict=True))


def _ordered(columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The rows in the order of anchor, content and place, each place once: equal rows of the table are one document here."""
    order = np.lexsort([columns[c] for c in ("start", "tie", "doc", "content", "anchor")])
    rows = {k: v[order] for k, v in columns.items()}
    return {k: v[_heads(rows, "anchor", "content", "doc", "tie", "start")] for k, v in rows.items()}


def _heads(rows: dict[str, np.ndarray], *names: str) -> np.ndarray:
    """Which rows differ from the one before in these columns."""
    differ = np.logical_or.reduce([rows[c][1:] != rows[c][:-1] for c in names])
    return np.append(True, differ)[: len(rows[names[0]])]


def _same_bytes(data: np.ndarray, one: np.ndarray, two: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes at one and two agree over size, at least 8, eight at a time."""
    words = np.zeros(max(0, len(data) - 7), _U)
    for k in range(8):
        words |= data[k : len(data) - 7 + k].astype(_U) << _U(8 * k)
    open_ = np.arange(len(one))
    same = np.ones(len(one), bool)
    k = 0
    while len(open_):
        at = np.minimum(k, size[open_] - 8)
        good = words[one[open_] + at] == words[two[open_] + at]
        same[open_[~good]] = False
        k += 8
        open_ = open_[good & (size[open_] > k)]
    return same


def _finder(cells: int, keep: int = KEEP) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (cell, copies, rows): stretches by cell of their anchor, and in any cell those that a task knows as covered."""

    def flush(held: list[dict[str, np.ndarray]], blocks: list[np.ndarray], salt: int) -> pa.RecordBatch:
        rows = _ordered({c: np.concatenate([h[c] for h in held]) for c in (*FIELDS, "at")})
        data = np.concatenate(blocks)
        head = np.flatnonzero(_heads(rows, "anchor", "content"))
        first = np.repeat(head, np.diff(np.append(head, len(rows["doc"]))))
        copy = np.arange(len(first)) - first > keep
        more, size = np.flatnonzero(copy), rows["end"] - rows["start"]
        same = size[more] == size[first[more]]
        same[same] = _same_bytes(data, rows["at"][more[same]], rows["at"][first[more[same]]], size[more[same]])
        copy[more[~same]] = False
        kept, gone = ({c: rows[c][x] for c in FIELDS} for x in (~copy, copy))
        cell = ((kept["anchor"] >> _U(32)) * _U(cells) >> _U(32)).astype(np.int64)
        at = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])[: len(cell)]).tolist()
        out = [(int(cell[a]), False, _packed({c: v[a:b] for c, v in kept.items()})) for a, b in zip(at, [*at[1:], len(cell)], strict=True)]
        step = 5_000
        out += [((salt + 7 * k) % cells, True, _packed({c: v[a : a + step] for c, v in gone.items()})) for k, a in enumerate(range(0, len(gone["doc"]), step))]
        return _table(out, pa.schema([("cell", pa.int32()), ("copies", pa.bool_()), ("rows", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        blocks: list[np.ndarray] = []
        n, size, salt = 0, 0, TaskContext.get().partitionId() * 31
        for batch, texts in slices(batches):
            doc, tie = (np.array(batch.column(c)) for c in ("doc", "tie"))
            for data, ends, number, base in _text_blocks([t.encode("utf-8", "surrogatepass") for t in texts]):
                anchor, content, part, start, end, marks = stretches(data, ends)
                if len(anchor):
                    at = size + np.append(0, ends)[part] + start
                    held.append(dict(zip((*FIELDS, "at"), (anchor, content, doc[number[part]], tie[number[part]], start + base[part], end + base[part], marks, at), strict=True)))
                    blocks.append(data)
                    n, size = n + len(anchor), size + len(data)
            if n >= HELD:
                yield flush(held, blocks, salt)
                held, blocks, n, size, salt = [], [], 0, 0, salt + 1
        if held:
            yield flush(held, blocks, salt)

    return run


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str, least: int) -> Iterator[pa.RecordBatch]:
    """Batches of `least` rows, or as many more as it takes not to cut a group of neighbours with one key."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys, at = table.column(key).to_numpy(), 0
        starts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        while (k := int(np.searchsorted(starts, at + least))) < len(starts):
            yield from table.slice(at, int(starts[k]) - at).to_batches()
            at = int(starts[k])
        held = table.slice(at).to_batches()
        size = table.num_rows - at
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


FOUND = "anchor long, doc long, tie long, start int, end int, covered boolean"


def _found(rows: dict[str, np.ndarray], covered: np.ndarray) -> pa.RecordBatch:
    columns = (rows["anchor"].view(np.int64), rows["doc"], rows["tie"], rows["start"].astype(np.int32), rows["end"].astype(np.int32), covered)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in FOUND.split(", ")])


def _agree(group: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Which rows have a mark that another of their group has in its place, too."""
    out = np.zeros(len(group), bool)
    for k in range(MARKS):
        mark = marks >> 8 * k & 255
        _, number, counts = np.unique(group * 256 + mark, return_inverse=True, return_counts=True)
        out |= (mark > 0) & (counts[number] > 1)
    return out


def _matcher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is covered, and the stretches with partners: those equal to another or agreeing with one around their anchor.

    Rows come in the order of their cell; a cell is worked out at a time.
    """

    def partnered(blobs: list[bytes]) -> pa.RecordBatch:
        rows = _ordered(_unpacked(blobs))
        group = np.cumsum(_heads(rows, "anchor"))
        fresh = np.flatnonzero(_heads(rows, "anchor", "content"))
        copies = np.diff(np.append(fresh, len(group)))
        keep = np.repeat((copies > 1) | _agree(group[fresh], rows["marks"][fresh]), copies)
        return _found({c: v[keep] for c, v in rows.items()}, np.zeros(int(keep.sum()), bool))

    held: list[bytes] = []
    now = None
    for batch in batches:
        for cell, copies, packed in zip(*(batch.column(c) for c in ("cell", "copies", "rows")), strict=True):
            if copies.as_py():
                gone = _unpacked([packed.as_py()])
                yield _found(gone, np.ones(len(gone["doc"]), bool))
                continue
            if held and cell.as_py() != now:
                yield partnered(held)
                held = []
            now = cell.as_py()
            held.append(packed.as_py())
    if held:
        yield partnered(held)


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that the stretches cover; stretches that touch are one run."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order]) if len(end) else end
    first = np.flatnonzero(np.append(True, start[1:] > reach[:-1])[: len(start)])
    return start[first], reach[np.append(first[1:], len(start)).astype(np.int64) - 1] if len(first) else reach


def _cut(data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[int, int, str]:
    """(bytes removed, runs, digest of what stays)."""
    start, end = merged(start, end)
    kept, at = hashlib.sha256(), 0
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        kept.update(data[at:a])
        at = b
    kept.update(data[at:])
    return int((end - start).sum()), len(start), kept.hexdigest()


PARTS = "anchor long, doc long, tie long, start int, data binary"
RESULTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
RESULT = tuple(x.split()[0] for x in RESULTS.split(", "))
_RESULTS = pa.schema([(n, pa.string() if n == "kept_sha256" else pa.int64()) for n in RESULT])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema.names)


def _lists(column: pa.ListArray, *fields: str) -> tuple[list[int], dict[str, pa.Array]]:
    """Where the lists of a column begin and end, a null one as empty, and the fields of all their elements."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    return np.append(0, np.cumsum(sizes)).tolist(), {f: flat.field(f) for f in fields}


_PARTS = pa.schema([("anchor", pa.int64()), ("doc", pa.int64()), ("tie", pa.int64()), ("start", pa.int32()), ("data", pa.binary())])


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the stretches with partners."""
    for batch, texts in slices(batches):
        at, fields = _lists(batch.column("asked"), "anchor", "start", "end")
        start, end = (fields[c].to_pylist() for c in ("start", "end"))
        data: list[bytes] = []
        for a, b, text in zip(at, at[1:], texts, strict=False):
            whole = text.encode("utf-8", "surrogatepass")
            data += [whole[x:y] for x, y in zip(start[a:b], end[a:b], strict=True)]
        if data:
            doc, tie = (np.repeat(batch.column(c).to_numpy(), np.diff(at)) for c in ("doc", "tie"))
            yield pa.RecordBatch.from_arrays([fields["anchor"], pa.array(doc), pa.array(tie), fields["start"], pa.array(data, pa.binary())], _PARTS.names)


def repeated_windows(parts: list[bytes], rank: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, first start, last start) of windows that also start earlier, by the suffix array of all parts.

    rank orders the parts; parts of one document don't share a start.
    """
    size = np.array([len(p) for p in parts], np.int32)
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]]).astype(np.int32)
    at = np.arange(int((size + 1).sum()), dtype=np.int32)
    text = np.frombuffer(b"\xff".join([*parts, b""]), np.uint8) + np.uint8(1)
    symbols = 256
    if np.count_nonzero(text == 0) > len(parts):  # 255 is in a part, which UTF-8 never is
        text, symbols = text.astype(np.uint16), 257
        text[text == 0] = 256
        text[begin + size] = 0
    sa = suffix_array(text, symbols)
    equal = common_prefixes(text, sa, LENGTH)[sa] >= LENGTH
    whole = (np.repeat(begin + size, size + 1) - at >= LENGTH)[sa]
    equal[1:] &= whole[1:] & whole[:-1]
    #: Of a run of equal windows the first is not marked as equal to the one before it.
    among = np.flatnonzero(equal | np.append(equal[1:], False))
    later = np.zeros(len(text), bool)
    if len(among):
        place = (np.repeat(rank * np.int64(1 << 32) - begin, size + 1) + at)[sa[among]]
        run = np.flatnonzero(~equal[among])
        first = np.minimum.reduceat(place, run)
        later[sa[among]] = place > np.repeat(first, np.diff(np.append(run, len(among))))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], later.astype(np.int8), [0]])))
    of = np.searchsorted(begin, edge[::2], "right") - 1
    for part, a, b in zip(of.tolist(), (edge[::2] - begin[of]).tolist(), (edge[1::2] - 1 - begin[of]).tolist(), strict=True):
        yield part, a, b


def _later_copies(parts: list[bytes], order: np.ndarray, keep: int = KEEP) -> np.ndarray:
    """Which parts equal, byte by byte, more than `keep` that come before them in the order."""
    seen: dict[bytes, int] = {}
    copy = np.zeros(len(parts), bool)
    for i in order.tolist():
        n = seen[parts[i]] = seen.get(parts[i], -1) + 1
        copy[i] = n > keep
    return copy


def _sorter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered stretches by the suffix arrays of shards of whole anchor groups; of equal stretches KEEP + 1 are sorted."""
    for batch in _whole_groups(batches, "anchor", SHARD // (LENGTH + 40)):
        #: Equal stretches stand apart, so that few names are tied beyond one of them.
        batch = batch.take(np.random.default_rng(len(batch)).permutation(len(batch)))
        doc, tie, start = (batch.column(c).to_numpy() for c in ("doc", "tie", "start"))
        order = np.lexsort([start, tie, doc])
        rank = np.empty(len(doc), np.int64)
        rank[order] = np.arange(len(doc))
        parts = batch.column("data").to_pylist()
        copy = _later_copies(parts, order)
        gone, kept = np.flatnonzero(copy), np.flatnonzero(~copy)
        windows = np.array(list(repeated_windows([parts[i] for i in kept.tolist()], rank[kept])), np.int64).reshape(-1, 3)
        of = np.append(gone, kept[windows[:, 0]])
        if len(of):
            begin = start[of] + np.append(np.zeros(len(gone), np.int64), windows[:, 1])
            end = np.append(start[gone] + np.array([len(parts[i]) for i in gone.tolist()], np.int64), start[kept[windows[:, 0]]] + windows[:, 2] + LENGTH)
            yield pa.RecordBatch.from_arrays([pa.array(doc[of]), pa.array(tie[of]), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))], ["doc", "tie", "start", "end"])


def _closer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches):
        at, fields = _lists(batch.column("covered"), "start", "end")
        start, end = (fields[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "end"))
        rows = []
        for doc_id, a, b, text in zip(batch.column("doc_id").to_pylist(), at, at[1:], texts, strict=False):
            data = text.encode("utf-8", "surrogatepass")
            rows.append((doc_id, len(data), *_cut(data, start[a:b], end[a:b])))
        if rows:
            yield _table(rows, _RESULTS)


def _whole(touched) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Results of the documents that lose nothing, by the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            calm = batch.filter(pa.array(~passes(touched.value, np.array(batch.column("spot")))))
            for part, texts in slices([calm]):
                data = [t.encode("utf-8", "surrogatepass") for t in texts]
                yield _table([(i, len(d), 0, 0, hashlib.sha256(d).hexdigest()) for i, d in zip(part.column("doc_id").to_pylist(), data, strict=True)], _RESULTS)

    return run


def _chosen(touched) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The other documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(touched.value, np.array(batch.column("spot")))))

    return run


def _twins(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first of wholly equal rows, and the results of the others, which lose all if they hold a window."""
    numbered = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("doc", "tie").orderBy(F.lit(0))))
    size, data = F.octet_length(utf8("text")).cast("long"), utf8("text")
    gone = size >= LENGTH
    lost = (size, F.when(gone, size).otherwise(0).cast("long"), F.when(gone, 1).otherwise(0).cast("long"), F.sha2(F.when(gone, F.lit(b"")).otherwise(data), 256))
    again = numbered.where("_n > 1").select("doc_id", *(c.alias(n) for c, n in zip(lost, RESULT[1:], strict=True)))
    return numbered.where("_n = 1").drop("_n"), again


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs (doc_id long, text string).

    Earlier is a smaller doc_id, a null one before all, or an earlier start; rows that share an id are in the order of
    a hash of their texts, and wholly equal rows one after the other. Null and empty texts have no bytes; texts under
    LENGTH bytes lose nothing. Other columns are ignored. An empty table gives no rows.
    """
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    unique = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    #: Where every id is its own, no tie is left to break, and a constant takes no room in the shuffle.
    tie = F.lit(0).cast("long") if unique else F.xxhash64("text")
    keyed = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), tie.alias("tie"))
    parts = shuffle_partitions(spark)
    rows = keyed.select("doc", "tie", "text").mapInArrow(_finder(CELLS * parts), "cell int, copies boolean, rows binary")
    found = stored(rows.repartitionById(parts, F.expr(f"cell div {CELLS}").cast("int")).sortWithinPartitions("cell").mapInArrow(_matcher, FOUND), "found")

    texts, again = (keyed, None) if unique else _twins(keyed)
    texts = texts.withColumn("spot", spot("doc", "tie"))
    filtered = lambda rows: spark.sparkContext.broadcast(bit_filter(rows.select(spot("doc", "tie").alias("spot")), rows.select("doc", "tie").distinct().count()))

    asked = found.where("not covered").groupBy("doc", "tie").agg(F.collect_list(F.struct("anchor", "start", "end")).alias("asked"))
    open_ = texts.mapInArrow(_chosen(filtered(found.where("not covered"))), texts.schema).join(asked, ["doc", "tie"])
    pieces = open_.select("doc", "tie", "asked", "text").mapInArrow(_cutter, PARTS)
    late = pieces.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sorter, "doc long, tie long, start int, end int")

    covered = found.where("covered").select("doc", "tie", "start", "end").unionByName(stored(late, "late"))
    touched = filtered(covered)
    runs = covered.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "end")).alias("covered"))
    cut = texts.mapInArrow(_chosen(touched), texts.schema).join(runs, ["doc", "tie"], "left").select("doc_id", "text", "covered").mapInArrow(_closer, RESULTS)
    out = cut.unionByName(texts.select("doc_id", "spot", "text").mapInArrow(_whole(touched), RESULTS))
    return out if again is None else out.unionByName(again)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir))
