"""Token ids as length-delimited binary records with a separate offset index.

A record frames one document's sequence: its length (8 bytes), the masked CRC-32 of that length (4), the sequence,
and the sequence's masked CRC-32 (4). A sequence starts with the document's id (8), a byte that says whether the id
is there, the width of a token id in bytes, two spare bytes and the number of tokens (4); the token ids follow, two
bytes each where the vocabulary fits, else four. All numbers are little-endian. Beside each file stands an index of
8-byte offsets, one per record and one for the end, so that any record can be read without the others.

Files are written through pyarrow's file systems into the shared folder, under a name of their own for each attempt
and then renamed, so a task that runs twice leaves one whole file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowgraph.llm import bpe
from flowgraph.llm.common import checkpoint, documents, fresh_dir, slices

END_ID = 2
HEAD, SEQUENCE = struct.Struct("<QI"), struct.Struct("<qBBxxI")
BUFFER = 8 << 20


class BadRecord(ValueError):
    """A length, checksum or offset does not hold."""


def masked(data: bytes) -> int:
    """CRC-32, turned right by 15 bits and shifted by a constant, so that a checksum of checksums stays useful."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(sequence: bytes) -> bytes:
    size = struct.pack("<Q", len(sequence))
    return b"".join((size, struct.pack("<I", masked(size)), sequence, struct.pack("<I", masked(sequence))))


def pack(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return SEQUENCE.pack(doc_id or 0, doc_id is not None, width, len(ids)) + ids.astype(f"<u{width}").tobytes()


def unpack(sequence: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, there, width, n = SEQUENCE.unpack_from(sequence)
    if len(sequence) != SEQUENCE.size + n * width:
        raise BadRecord("the sequence's length doesn't match its number of tokens")
    return doc_id if there else None, np.frombuffer(sequence, f"<u{width}", n, SEQUENCE.size)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def write_file(path: str, rows: Iterable[tuple[int | None, np.ndarray]], width: int) -> tuple[int, int]:
    """Writes path.rec and path.idx; gives the numbers of records and tokens."""
    store, base = _open(path)
    store.create_dir(base.rpartition("/")[0], recursive=True)
    own, offsets, tokens = f"{base}.{uuid.uuid4().hex}", [0], 0
    with store.open_output_stream(f"{own}.rec", buffer_size=BUFFER) as out:
        for doc_id, ids in rows:
            record = frame(pack(doc_id, ids, width))
            out.write(record)
            offsets.append(offsets[-1] + len(record))
            tokens += len(ids)
    with store.open_output_stream(f"{own}.idx", buffer_size=BUFFER) as out:
        out.write(np.array(offsets, "<u8").tobytes())
    for end in ("rec", "idx"):
        store.move(f"{own}.{end}", f"{base}.{end}")
    return len(offsets) - 1, tokens


def read_file(path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """All records of path.rec in turn, each checked against its checksums and the index."""
    store, base = _open(path)
    with store.open_input_stream(f"{base}.idx") as at, store.open_input_stream(f"{base}.rec", buffer_size=BUFFER) as src:
        place, (due,) = 0, struct.unpack("<Q", at.read(8))
        while place == due and (head := src.read(HEAD.size)):
            size, check = HEAD.unpack(head)
            if masked(head[:8]) != check:
                raise BadRecord(f"{path}: a length's checksum is wrong at {place}")
            sequence, check = src.read(size), src.read(4)
            if len(sequence) != size or masked(sequence) != int.from_bytes(check, "little"):
                raise BadRecord(f"{path}: a sequence's checksum is wrong at {place}")
            place += HEAD.size + size + 4
            (due,) = struct.unpack("<Q", at.read(8))
            yield unpack(sequence)
        if place != due or at.read(1):
            raise BadRecord(f"{path}: the index does not match the file at {place}")


def read_record(path: str, k: int) -> tuple[int | None, np.ndarray]:
    """Record k alone, by way of the index."""
    store, base = _open(path)
    with store.open_input_file(f"{base}.idx") as index:
        index.seek(8 * k)
        start, end = struct.unpack("<QQ", index.read(16))
    with store.open_input_file(f"{base}.rec") as src:
        src.seek(start)
        record = src.read(end - start)
    sequence = record[HEAD.size : -4]
    if frame(sequence) != record:
        raise BadRecord(f"{path}: record {k} does not hold what it says")
    return unpack(sequence)


def _writer(folder: str, path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = bpe.encoder(path), TaskContext.get().partitionId()
        width = 2 if max(encoder.vocab_size, END_ID + 1) <= 1 << 16 else 4

        def rows() -> Iterator[tuple[int | None, np.ndarray]]:
            for batch, texts in slices(batches, bpe.SLICE):
                ids, counts = encoder.encode(texts)
                ends = np.cumsum(counts)
                for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), (ends - counts).tolist(), ends.tolist(), strict=True):
                    yield doc_id, np.append(ids[a:b], np.uint32(END_ID))

        name = f"{folder}/part-{part:06d}"
        n, tokens = write_file(name, rows(), width)
        if n:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [name], "records": [n], "tokens": [tokens]})

    return run


def write(docs: DataFrame, folder: str, path: str) -> DataFrame:
    """Writes docs (doc_id long, text string) in ascending doc_id order and gives the manifest: part, path, records, tokens.

    The files hold the documents in the order of their parts; null ids come first; equal ids stand in the order of
    their texts, a null text being empty. Each document ends with END_ID, so an empty one has one token. An empty
    table gives files without records and an empty manifest. Other columns are ignored.
    """
    ranged = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    return checkpoint(ranged.mapInArrow(_writer(folder, path), "part int, path string, records long, tokens long"))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
            out: list[tuple] = []
            for doc_id, ids in read_file(name):
                out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                start += len(ids)
                if len(out) == 10_000:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read(manifest: DataFrame) -> DataFrame:
    """Per record: doc_id, start (tokens of all records before it), n_tokens, ids_crc32. Each file is one task's work.

    The running sum goes over the manifest's rows, one per file and not per document.
    """
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("part", "path", before.alias("start"))
    return files.repartition(max(1, manifest.count()), "part").mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(documents(spark, sf_dir), fresh_dir(spark, "records"), bpe.default_path()))
