import hashlib
import random

import numpy as np
import pytest

from flowgraph.llm import induced, suffix_dedup


def brute(rows, length=100):
    """(doc_id, bytes, removed, runs, digest) by a table of all windows, rows in their order."""
    seen, out = set(), []
    for doc_id, text, *_ in rows:
        data = (text or "").encode()
        mark = bytearray(len(data))
        for p in range(len(data) - length + 1):
            window = data[p : p + length]
            if window in seen:
                mark[p : p + length] = b"\1" * length
            seen.add(window)
        kept = bytes(c for c, m in zip(data, mark) if not m)
        runs = sum(m and not (p and mark[p - 1]) for p, m in enumerate(mark))
        out.append((doc_id, len(data), sum(mark), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, docs_dir, seed):
    r = random.Random(seed)
    say = lambda n: " ".join(r.choice(["alpha", "be", "gamma é", "d", "漢字", "zz\n"]) + str(r.randrange(99)) for _ in range(n))
    passages = [say(n) for n in (8, 14, 20, 40, 200)]
    period = (say(6) * 30)[:900]
    texts = [None, "", "x" * 99, "y" * 100, "y" * 101, "z" * 5000, period, period[13:], "q" * 50 + period + "q" * 120]
    for _ in range(120):
        parts = [r.choice([say(r.randint(0, 30)), r.choice(passages), r.choice(passages)[r.randrange(40) :], r.choice(texts[-3:])[: r.randint(0, 400)]]) for _ in range(r.randint(1, 5))]
        texts.append("".join(parts))
    texts += r.sample(texts, 25)
    ids = r.sample(range(10_000), len(texts))
    rows = sorted((i, t, "en", "s") for i, t in zip(ids, texts))
    got = sorted(tuple(x) for x in suffix_dedup.query(spark, docs_dir(rows)).collect())
    want = brute(rows)
    assert got == want
    assert sum(x[2] for x in want) > 5_000


def test_repeated_and_null_ids(spark, docs_dir):
    """Rows of one id in some fixed order; wholly equal rows lose all but the first."""
    long = "".join(chr(97 + i * i % 23) + str(i) for i in range(80))
    rows = [(5, long, "en", "s")] * 3 + [(None, long, "en", "s"), (5, "short", "en", "s"), (5, "short", "en", "s"), (9, "pre " + long, "en", "s"), (None, None, "en", "s")]
    got = sorted((tuple(x)[:4] for x in suffix_dedup.query(spark, docs_dir(rows)).collect()), key=str)
    n = len(long)
    assert got == sorted([(5, n, n, 1)] * 3 + [(None, n, 0, 0), (5, 5, 0, 0), (5, 5, 0, 0), (9, n + 4, n, 1), (None, 0, 0, 0)], key=str)


def test_empty_table(spark, docs_dir):
    assert suffix_dedup.query(spark, docs_dir([])).count() == 0


def test_stretches_depend_on_windows_alone():
    r = np.random.default_rng(0)
    a, b = (r.integers(97, 101, 700, dtype=np.uint8) for _ in range(2))
    b[200:500] = a[100:400]
    anchors = []
    for data in (a, b):
        anchor, _, _, start, end, *_ = suffix_dedup.stretches(data, np.array([len(data)]))
        assert start[0] == 0 and end[-1] == 700 and (start[1:] == end[:-1] - 99).all()
        anchors.append(np.repeat(anchor, end - start - 99))
    assert (anchors[0][100:301] == anchors[1][200:401]).all()
    both = suffix_dedup.stretches(np.concatenate([a, b]), np.array([700, 1400]))
    assert [x.tolist() for x in both[3:5]] == [sum(x, []) for x in zip(*([y.tolist() for y in suffix_dedup.stretches(d, np.array([700]))[3:5]] for d in (a, b)))]


def test_anchors_spread_over_cells():
    data = np.random.default_rng(1).integers(0, 256, 200_000, dtype=np.uint8)
    anchor, *_ = suffix_dedup.stretches(data, np.array([len(data)]))
    counts = np.bincount((anchor >> np.uint64(60)).astype(int), minlength=16)
    assert counts.min() > 0.7 * counts.mean() and counts.max() < 1.3 * counts.mean()


def test_long_texts_come_in_overlapping_blocks(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 300)
    texts = [b"a" * 10, bytes(range(256)) * 5, b"", b"b" * 301, b"c" * 300]
    windows = {(k, p) for k, t in enumerate(texts) for p in range(len(t) - 99)}
    seen = []
    for data, ends, number, base in suffix_dedup._text_blocks(texts):
        for k, at, a, b in zip(number.tolist(), base.tolist(), [0, *ends[:-1].tolist()], ends.tolist()):
            assert data[a:b].tobytes() == texts[k][at : at + b - a]
            seen += [(k, at + p) for p in range(b - a - 99)]
    assert sorted(seen) == sorted(windows)


@pytest.mark.parametrize(("small", "step"), [(1, 128), (2048, 2)])
def test_suffix_array_and_prefixes(monkeypatch, small, step):
    monkeypatch.setattr(induced, "SMALL", small)
    monkeypatch.setattr(induced, "STEP", step)
    r = random.Random(small)
    for _ in range(400):
        symbols = r.choice([1, 2, 3, 5, 20])
        text = [r.randrange(symbols) for _ in range(r.randint(1, 60))]
        text = (text * 4)[: r.randint(1, 120)] if r.random() < 0.3 else text
        sa = induced.suffix_array(np.array(text), symbols)
        assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        shared, most = induced.common_prefixes(np.array(text), sa, 7), 7
        for a, b in zip(sa[:-1].tolist(), sa[1:].tolist()):
            n = next((k for k, (x, y) in enumerate(zip(text[a:], text[b:])) if x != y), min(len(text) - a, len(text) - b))
            assert min(most, shared[b]) == min(most, n)


def test_merged_runs():
    start, end = suffix_dedup.merged(np.array([5, 0, 20, 8]), np.array([9, 5, 30, 12]))
    assert (start.tolist(), end.tolist()) == ([0, 20], [12, 30])
    assert [x.tolist() for x in suffix_dedup.merged(np.zeros(0, int), np.zeros(0, int))] == [[], []]


def test_whole_groups():
    import pyarrow as pa

    r = random.Random(1)
    keys = sorted(r.choices(range(30), k=200) + [7] * 60)
    batches = [pa.RecordBatch.from_pydict({"k": pa.array(keys[a : a + 37], pa.int64())}) for a in range(0, len(keys), 37)]
    out = [b.column("k").to_pylist() for b in suffix_dedup._whole_groups(iter([batches[0].slice(0, 0), *batches]), "k", 20)]
    assert sum(out, []) == keys and all(not set(a) & set(b) for a, b in zip(out, out[1:]))
    assert max(map(len, out)) <= 20 + max(keys.count(k) for k in set(keys))


def test_a_shard_sorts_two_of_equal_stretches(monkeypatch):
    """Forty copies of a stretch and two that begin later in it: two copies are sorted, and all but the first are covered."""
    import pyarrow as pa

    r = random.Random(4)
    one = bytes(r.randrange(32, 127) for _ in range(150))
    rows = [(7, 60 + k, k, one) for k in range(40)] + [(7, 5, 9, one[20:]), (7, 300, 0, b"x" * 30 + one[:110])]
    r.shuffle(rows)
    sizes = []
    build = suffix_dedup.suffix_array
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda text, size: sizes.append(len(text)) or build(text, size))
    batch = pa.RecordBatch.from_arrays([pa.array([a for a, *_ in rows]), pa.array([d for _, d, *_ in rows]), pa.array([0] * len(rows)), pa.array([s for *_, s, _ in rows], pa.int32()), pa.array([t for *_, t in rows], pa.binary())], suffix_dedup._PARTS.names)
    (out,) = suffix_dedup._sorter(iter([batch]))
    covered = {}
    for x in out.to_pylist():
        covered.setdefault(x["doc"], set()).update(range(x["start"], x["end"]))
    want = {60 + k: set(range(k, k + 150)) for k in range(1, 40)} | {60: set(range(20, 150)), 300: set(range(30, 140))}
    assert covered == want and sizes == [2 * 151 + 131 + 141]


@pytest.mark.parametrize("high", [254, 255])
def test_repeated_windows_of_any_bytes(high):
    r = random.Random(high)
    word = lambda: bytes(r.choice([0, 1, high, 65]) for _ in range(r.randint(1, 90)))
    words = [word() for _ in range(6)]
    parts = [b"".join(r.choice(words) for _ in range(r.randint(1, 8))) for _ in range(30)] + [bytes([high]) * 260]
    seen, want = set(), set()
    for k, p in enumerate(parts):
        for i in range(len(p) - 99):
            if p[i : i + 100] in seen:
                want.add((k, i))
            seen.add(p[i : i + 100])
    got = {(k, i) for k, a, b in suffix_dedup.repeated_windows(parts, np.arange(len(parts))) for i in range(a, b + 1)}
    assert got == want and len(want) > 100
