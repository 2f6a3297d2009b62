import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from flowgraph.llm import bpe, decontaminate, language_id, packing


def check_packed(rows, pieces, length):
    t = Tokenizer.from_file(bpe.default_path())
    want = Counter()
    for i, text, *_ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append((p.offset, p.length))
        by_doc[p.doc_id].append(p)
    for held in by_sequence.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at and n > 0
            at += n
        assert at <= length
    total = sum(n * k for (_, n, _), k in want.items())
    assert sum(p.length for p in pieces) == total
    for (i, n, crc), k in want.items():
        own = [p for p in by_doc[i] if p.doc_tokens == n]
        assert sum(p.length for p in own if p.start == 0) >= 0 and len({p.start for p in own}) == -(-n // length)
        if n <= length:
            assert sum(p.ids_crc32 == crc for p in own) >= k
    return len(by_sequence), total


def test_packing(spark, docs_dir, odd_rows):
    rows = odd_rows + [(1000 + i, "word " * (i % 300), "en", "s") for i in range(400)] + [(7, "again", "en", "s")] * 3
    out = packing.query(spark, docs_dir(rows)).collect()
    sequences, total = check_packed(rows, out, 2048)
    assert sequences <= 1.05 * total / 2048 + 1
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string").repartition(9)
    small = packing.pack(docs, bpe.default_path(), length=64, most=3, fan=2).collect()
    check_packed(rows, small, 64)


def test_packing_empty(spark, docs_dir):
    assert packing.query(spark, docs_dir([])).count() == 0


def test_windows_emit_the_fullest():
    w, names, emitted = packing.Windows(10, 2), iter(range(9)), []
    for size in (6, 7, 5, 3):
        emitted += [(a, b) for a, b, _ in w.place(size, size, lambda: next(names))]
    assert emitted == [(1, 7)] and sorted(w.held) == [0, 2]


def slow_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers_equals_the_table():
    r = random.Random(3)
    for _ in range(150):
        item = "".join(r.choice("abc ") for _ in range(r.randint(1, 80)))
        text = "".join(r.choice("abc ") for _ in range(r.randint(0, 90)))
        assert decontaminate.Pattern(1, item, 0.1).best(text)[0] == slow_distance(item, text)


def test_leaks_equal_brute_force(spark, tmp_path):
    r = random.Random(5)
    words = ["".join(r.choice("etaoinsh") for _ in range(r.randint(2, 7))) for _ in range(60)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, say(r.randint(8, 30))) for i in range(12)] + [(50, None), (51, "short"), (52, "")]
    items.append((60, items[0][1]))
    docs = [(None, say(40)), (1, None), (2, ""), (3, say(3000))]
    for i in range(60):
        passage = list(items[i % 12][1])
        for _ in range(i % 9):
            at = r.randrange(len(passage))
            passage[at : at + r.randint(0, 1)] = r.choice(["x", "", " "])
        docs.append((100 + i, f"{say(20)}\n {''.join(passage).upper() if i % 2 else ''.join(passage)}  {say(5)}"))
    want = set()
    for i, text in docs:
        for item, passage in items:
            passage = decontaminate.normal(passage)
            if len(passage) >= decontaminate.MIN_CHARS and (d := slow_distance(passage, decontaminate.normal(text))) <= decontaminate.budget(len(passage)):
                want.add((i, item, d))
    assert 20 < len(want) < 80
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert {(x.doc_id, x.item_id, x.edits) for x in decontaminate.query(spark, str(tmp_path)).collect()} == want
    all_docs = spark.createDataFrame([(i, t, "extra") for i, t in docs], "doc_id long, text string, item_id string")
    bench = spark.read.parquet(str(tmp_path / "benchmark.parquet"))
    assert {(x[0], x[1], x[2]) for x in decontaminate.hits(all_docs, bench, limit=200).collect()} == want
    kept = decontaminate.clean(all_docs, bench, limit=200)
    assert kept.columns == all_docs.columns and {x.doc_id for x in kept.collect()} == {i for i, _ in docs} - {i for i, *_ in want}
    assert decontaminate.clean(all_docs, bench.where("false")).count() == len(docs)
    assert decontaminate.hits(all_docs.where("false"), bench).count() == 0


def slow_grams(text):
    out, word = Counter(), ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
            continue
        if word:
            out.update(word)
            edged = f"\x01{word}\x01"
            out.update(edged[i : i + n] for n in (2, 3) for i in range(len(edged) - n + 1))
        word = ""
    return out


def test_grams_equal_a_plain_count(monkeypatch):
    decode = lambda k: "".join(chr(k >> s & (1 << 21) - 1) for s in (42, 21, 0) if k >> s & (1 << 21) - 1)
    for text in ("", " ", "123", "a", "It's ñandú, élan! 漢字 x", "ab ab\nab" * 9):
        keys, counts = language_id.grams(text)
        assert {decode(int(k)): int(n) for k, n in zip(keys, counts)} == slow_grams(text)
    long = "alpha beta gamma, " * 2000
    whole = language_id.grams(long)
    monkeypatch.setattr(language_id, "PART", 1000)
    assert all((a == b).all() for a, b in zip(language_id.grams(long), whole))


def test_language_held_out(spark, docs_dir, odd_rows):
    r = random.Random(1)
    sounds = {"xx": "ka lo mi nu pe".split(), "yy": "stra brek tolk vint".split()}
    rows = [(10_000 + i, " ".join("".join(r.choice(sounds[lang]) for _ in range(r.randint(1, 3))) for _ in range(30)), lang, "s") for i in range(300) for lang in [("xx", "yy")[i % 2]]]
    got = language_id.query(spark, docs_dir(rows + [(i, t, None, s) for i, t, _, s in odd_rows])).collect()
    assert len(got) == len(rows) + len(odd_rows)
    truth = {i: lang for i, _, lang, _ in rows}
    for x in got:
        assert 0 <= x.score <= 1 and x.held_out == (zlib.crc32(str(x.doc_id).encode() if x.doc_id is not None else b"") % 4 == 2)
        if x.doc_id in truth:
            assert x.lang_pred == truth[x.doc_id]
    by = {i: t for i, t, *_ in odd_rows}
    assert {x.doc_id for x in got if x.lang_pred == "und"} == {i for i, t in by.items() if not any(c.isalpha() for c in t or "")}


def test_language_learns_nothing_from_nothing(spark, docs_dir):
    assert language_id.query(spark, docs_dir([])).count() == 0
    out = language_id.query(spark, docs_dir([(1, "hello", None, "s")], "one")).collect()
    assert [(x.lang_pred, x.score) for x in out] == [("und", 0.0)]
