import random
import re
from collections import defaultdict

import numpy as np
import pytest

from flowgraph.llm import ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows, percent=80):
    """(doc_id, set size, component's least id) of each row, from all pairs."""
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
                links += 1
    groups = defaultdict(list)
    for k, r in enumerate(rows):
        groups[find(k)].append(r[0])
    low = {k: min((i for i in ids if i is not None), default=None) for k, ids in groups.items()}
    return sorted(((r[0], len(sets[k]), low[find(k)]) for k, r in enumerate(rows)), key=str), links


def compare(spark, rows, percent=80):
    docs = spark.createDataFrame([(r[0], r[1], "n") for r in rows], "doc_id long, text string, n string").repartition(5)
    out = ngram_join.join(docs, percent=percent).collect()
    want, links = brute(rows, percent)
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in out), key=str) == want
    return links


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, odd_rows, seed):
    """Chains of edited copies, whose links run through single members, among documents that share a long passage."""
    r = random.Random(seed)
    say = lambda n: [r.choice("abcdefgh") + str(r.randrange(40)) for _ in range(n)]
    passage = say(60)
    rows = list(odd_rows)
    for family in range(12):
        text = say(r.randint(5, 120))
        for k in range(r.choice([1, 3, 25])):
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                text[r.randrange(len(text))] = say(1)[0]
            shown = text if r.random() < 0.5 else say(r.randint(0, 8)) + text
            shown = shown + passage if family % 3 == 0 else shown
            rows.append((10_000 - len(rows), r.choice([" ", "  ", "\n"]).join(w.upper() if r.random() < 0.1 else w for w in shown), "en", "s"))
    rows += [(5, rows[-1][1], "en", "s"), (5, "same id " * 3, "en", "s"), (None, rows[-2][1], "en", "s"), (6, "TWO words", "x", "y"), (7, "two\tWORDS", "x", "y")]
    assert compare(spark, rows) > 50


def test_second_round_finds_links_between_groups(spark):
    """Sets for which the least node of a shared token does not link, but another does."""
    r = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(120):
        at, n = r.randrange(60), r.randint(60, 140)
        rows.append((i, " ".join(base[at : at + n]), "en", "s"))
    assert compare(spark, rows) > 100
    assert compare(spark, rows, percent=60) > 100


def test_empty_table(spark, docs_dir):
    assert ngram_join.query(spark, docs_dir([])).count() == 0


def test_only_blank_texts(spark):
    compare(spark, [(1, None), (2, ""), (3, " \n"), (None, None)])


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    texts = [b"Some words  and a verylongword", b"", b" ", "é x".encode(), b"tail " * 50]
    whole = [h.tolist() for h in ngram_join.word_hashes(texts)]
    assert whole == [ngram_join.word_hashes([t])[0].tolist() for t in texts]
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    assert whole == [h.tolist() for h in ngram_join.word_hashes(texts)]
    assert len(whole[0]) == 5 and len(whole[4]) == 50 and len(set(whole[4])) == 1


@pytest.mark.parametrize("local", [0, 40, 1 << 20])
def test_components(spark, local):
    r = random.Random(3)
    edges = [(a, r.choice([a - 1, r.randrange(a)])) for a in r.sample(range(1, 300), 200)] + [(5, 5), (7, 2), (2, 7)]
    found = {x.node: x.root for x in ngram_join.components(spark.createDataFrame(edges, "a long, b long"), local).collect()}
    root = {x: x for e in edges for x in e}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert found == {x: find(x) for x in root if find(x) != x}


def test_links_is_exact_at_the_threshold():
    a = np.arange(10, dtype=np.uint64)
    assert ngram_join.links(a[:8], a) and not ngram_join.links(a[:7], a)
    assert ngram_join.links(a, np.arange(1, 10, dtype=np.uint64))


def test_crowded_shingles(spark, monkeypatch):
    """Many unlike variants of one text, compared in blocks, beside documents that share only a passage."""
    monkeypatch.setattr(ngram_join, "LIGHT", 3)
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", 16)
    r = random.Random(4)
    base, passage = [f"w{i}" for i in range(90)], [f"p{i}" for i in range(25)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(r.randint(0, 12)):
            text[r.randrange(90)] = f"x{r.randrange(10**6)}"
        own = [f"y{r.randrange(10**6)}" for _ in range(r.randint(0, 60))]
        rows.append((i, " ".join(text if i % 2 else own[:20] + passage + own[20:]), "en", "s"))
    assert compare(spark, rows) > 50


def test_full_nodes_that_share_only_light_shingles(spark, monkeypatch):
    """Two linked documents with a crowded passage each, P and Q, and the rest of them in common and in short documents."""
    monkeypatch.setattr(ngram_join, "LIGHT", 3)
    r = random.Random(6)
    common = [f"c{i}" for i in range(166)]
    texts = [" ".join(common[i : i + 5]) for i in range(162) for _ in range(8)]
    ends = [[f"{c}{i}" for i in range(20)] for c in "pq"]
    for window in [end[i : i + 5] for end in ends for i in range(16)]:
        token, more = ngram_join.text_sets([" ".join(window)])[0][0], []
        while len(more) < 3:
            text = " ".join([*window, f"y{r.randrange(10**9)}"])
            if ngram_join.text_sets([text])[0][0] == token:
                more.append(text)
        texts += [" ".join(window), *more]
    rows = list(enumerate([*texts, *(" ".join(common + end) for end in ends)]))
    assert ngram_join.links(*ngram_join.text_sets([t for _, t in rows[-2:]]))
    out = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    want, _ = brute(rows)
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in out), key=str) == want


def test_forest_joins_what_links_join():
    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 60, 100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([r.choice(base, r.integers(80, 100), False), r.integers(0, 1 << 60, r.integers(0, 9), dtype=np.uint64)])) for _ in range(60)]
    links = [(a, b) for a in range(60) for b in range(a + 1, 60) if ngram_join.links(sets[a], sets[b])]
    forest = ngram_join.linked_forest(sets)
    assert set(forest) <= set(links)
    part = lambda edges: len(ngram_join._forest(60, np.array([a for a, _ in edges]), np.array([b for _, b in edges])))
    assert part(links) == part(forest) == len(forest) > 5


def test_links_come_from_opened_groups(spark, monkeypatch):
    """Families of edited copies: the links that join them are found in groups that the matrix opens, not in blocks."""
    r = random.Random(3)
    rows = []
    for family in range(30):
        text = [f"f{family}w{i}" for i in range(r.randint(120, 200))]
        for k in range(r.choice([1, 2, 6])):
            own = list(text)
            own[10 * k + 7] = "edit"
            rows.append((len(rows), " ".join(own), "en", "s"))
    found = {"opened": 0, "blocks": 0}

    def counted(name, plain):
        def run(*args):
            out = ngram_join.checkpoint(plain(*args))
            found[name] += out.count()
            return out

        return run

    monkeypatch.setattr(ngram_join, "verified", counted("opened", ngram_join.verified))
    monkeypatch.setattr(ngram_join, "_full_links", counted("blocks", ngram_join._full_links))
    joined = len(rows) - len({c for _, _, c in brute(rows)[0]})
    assert compare(spark, rows) >= joined > 30
    assert found["opened"] >= joined and found["blocks"] == 0
