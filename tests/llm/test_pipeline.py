import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from flowgraph.llm import bpe, decontaminate, pii_crf
from tests.llm.test_language_packing_leaks import slow_distance
from tests.llm.test_ngram_join import shingles


def make(spark, tmp_path, rows, items):
    d = str(tmp_path / "in")
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def stages(spark, d):
    """What each stage returns, written and read again."""
    docs, out = spark.read.parquet(f"{d}/documents.parquet"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        df = stage(spark, docs, d)
        df.write.parquet(f"{d}/stage{k}")
        docs = spark.read.parquet(f"{d}/stage{k}")
        assert docs.columns == columns or k == len(corpus_pipeline.STAGES) - 1
        out.append(docs.collect())
    return out


def test_stages_equal_brute_force(spark, tmp_path):
    r = random.Random(8)
    sounds = {"xx": "ka lo mi nu pe".split(), "yy": "stra brek tolk vint".split()}
    say = lambda lang, n: ["".join(r.choice(sounds[lang]) for _ in range(r.randint(1, 4))) for _ in range(n)]
    items = [(i, " ".join(say("xx", 20))) for i in range(6)]
    rows = [(0, None, None, None), (1, "", "xx", "s"), (2, "12 34 !!", "xx", "s")]
    for i in range(160):
        lang = r.choice(["xx", "yy"])
        words = say(lang, r.randint(5, 200))
        if i % 7 == 0:
            words[3:3] = [items[i % 6][1]]
        if i % 5 == 0:
            words[2:2] = [f"me{i}@host{i % 9}.example.org", f"10.0.{i}.7", "+1 (988) 555-2485", f"4111 1111 1111 {i:04}"]
        rows.append((10 + i, " ".join(words), lang if i % 4 else None, f"s{i % 3}"))
        for k in range(r.choice([0, 0, 1, 3])):
            copy = list(words)
            copy[r.randrange(len(copy))] = "changed"
            rows.append((1000 + len(rows), " ".join(copy), lang, "s0"))
    r.shuffle(rows)
    d = make(spark, tmp_path, rows, items)
    language, near, leaks, private, packed = stages(spark, d)

    by = {x[0]: x for x in rows}
    letters = {i for i, x in by.items() if re.search(r"[^\W\d_]", x[1] or "")}
    assert {x.doc_id for x in language} == letters and len(language) == len(letters)
    assert all(tuple(x)[:4] == by[x.doc_id] for x in language)

    ids = sorted(letters)
    sets = {i: shingles(by[i][1]) for i in ids}
    root = {i: i for i in ids}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in ids:
        for b in ids:
            if b < a and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = {find(i) for i in ids}
    assert 0 < len(want) < len(ids)
    assert sorted(x.doc_id for x in near) == sorted(want)
    assert all(tuple(x)[:4] == by[x.doc_id] for x in near)

    bad = {i for i in want for _, t in items if slow_distance(decontaminate.normal(t), decontaminate.normal(by[i][1])) <= decontaminate.budget(len(decontaminate.normal(t)))}
    assert bad and sorted(x.doc_id for x in leaks) == sorted(want - bad)

    assert sorted(x.doc_id for x in private) == sorted(want - bad)
    changed = 0
    for x in private:
        text = by[x.doc_id][1]
        base = pii_crf.base_spans(text)
        assert not pii_crf.base_spans(x.text) and x.n_chars == len(x.text)
        changed += x.text != text
        assert (x.text != text) == bool(base), text
    assert changed > 3

    tokenizer = Tokenizer.from_file(bpe.default_path())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in packed:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append((p.offset, p.length))
    assert by_doc.keys() == {x.doc_id for x in private}
    for x in private:
        ids = [*tokenizer.encode(x.text, add_special_tokens=False).ids, 1]
        for p in by_doc[x.doc_id]:
            piece = ids[p.start : p.start + p.length]
            assert p.doc_tokens == len(ids) and zlib.crc32(np.array(piece, "<u4").tobytes()) == p.ids_crc32
        assert sum(p.length for p in by_doc[x.doc_id]) == len(ids)
    for held in by_sequence.values():
        held.sort()
        assert [a for a, _ in held] == np.cumsum([0] + [n for _, n in held])[:-1].tolist() and sum(n for _, n in held) <= 2048

    run = corpus_pipeline.run(spark, d).collect()
    pieces = lambda out: Counter((p.doc_id, p.start, p.length, p.ids_crc32) for p in out)
    assert pieces(run) == pieces(packed)


def test_odd_rows_and_repeated_ids(spark, tmp_path, odd_rows):
    rows = odd_rows + [(7, "Hello world it's fine", "en", "s")] * 2 + [(None, "no id", None, None)] * 2
    out = stages(spark, make(spark, tmp_path, rows, [(None, None), (1, "")]))
    assert {x.doc_id for x in out[0]} == {i for i, t, *_ in rows if re.search(r"[^\W\d_]", t or "")}
    assert Counter(shingles(x.text) for x in out[1]) == Counter({shingles(x.text): 1 for x in out[0]})


def test_empty_tables(spark, tmp_path):
    assert [len(x) for x in stages(spark, make(spark, tmp_path, [], []))] == [0] * 5
