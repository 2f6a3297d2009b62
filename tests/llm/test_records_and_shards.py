import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from flowgraph.llm import binary_records, bpe, sharding


def plain(texts):
    t = Tokenizer.from_file(bpe.default_path())
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_encoder_equals_library(odd_rows):
    texts = [t or "" for _, t, *_ in odd_rows] + ["tab\t\tx  y\n\n z", "123 45abc's", "  lead", "trail  ", "<|endoftext|> x"]
    encoder = bpe.Encoder(bpe.default_path(), keep=3)
    for _ in range(2):
        ids, counts = encoder.encode(texts)
        want = plain(texts)
        assert counts.tolist() == [len(x) for x in want]
        assert ids.tolist() == [i for x in want for i in x]


def test_records_round_trip(spark, docs_dir, odd_rows):
    rows = odd_rows + [(7, "again the same id", "en", "s")]
    out = {}
    for r in binary_records.query(spark, docs_dir(rows)).collect():
        out.setdefault(r.doc_id, []).append((r.start, r.n_tokens, r.ids_crc32))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, {}
    for (doc_id, *_), ids in zip(order, plain([r[1] or "" for r in order])):
        ids = [*ids, 2]
        want.setdefault(doc_id, []).append((start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert {k: sorted(v) for k, v in out.items()} == {k: sorted(v) for k, v in want.items()}


def test_file_format(tmp_path):
    path = str(tmp_path / "f")
    rows = [(5, np.array([1, 2, 65535])), (None, np.array([], int)), (-3, np.arange(1000))]
    assert binary_records.write_file(path, rows, 2) == (3, 1003)
    assert [(d, i.tolist()) for d, i in binary_records.read_file(path)] == [(d, i.tolist()) for d, i in rows]
    assert binary_records.read_record(path, 2)[1].tolist() == list(range(1000))
    raw = (tmp_path / "f.rec").read_bytes()
    assert struct.unpack_from("<Q", raw)[0] == 16 + 6
    for at in (3, 9, 20, len(raw) - 1):
        (tmp_path / "f.rec").write_bytes(raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :])
        with pytest.raises(binary_records.BadRecord):
            list(binary_records.read_file(path))


def test_empty_tables(spark, docs_dir):
    d = docs_dir([])
    assert binary_records.query(spark, d).count() == 0
    assert sharding.query(spark, d).count() == 0


def test_shards(spark, docs_dir, odd_rows):
    rows = odd_rows + [(1000 + i // 3, f"t{i // 2}", "en", "hot") for i in range(500)] + [(9, "same", "x", "y")] * 50
    out = sharding.query(spark, docs_dir(rows)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    by = Counter(r.shard for r in out)
    assert max(by.values()) - min(by.values()) <= 1 and len(by) == 24
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(n)) for s, n in by.items())


def test_walk_moves_only_overflow():
    owners = sharding.ring(5)
    counts = {s: s % 3 for s in range(0, sharding.GRID, 7)}
    total = sum(counts.values())
    runs = sharding.walk(owners, counts, [total // 5 + (s < total % 5) for s in range(5)])
    assert sum(b - a for _, a, b, *_ in runs) == total
    own = Counter()
    for step, n in counts.items():
        own[owners[step]] += n
    stay = sum(b - a for step, a, b, shard, _ in runs if owners[step] == shard)
    assert stay == sum(min(own[s], total // 5 + (s < total % 5)) for s in range(5))
    grown = sharding.ring(6)
    assert all(a == b or b == 5 for a, b in zip(owners, grown))
