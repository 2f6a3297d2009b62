import numpy as np
import pyarrow as pa
import pytest

from flowgraph.llm import common, decontaminate, language_id, pii_crf, token_counts


@pytest.mark.parametrize(
    ("word", "want"),
    [
        ("4111111111111111", "99"), ("+1-555-0134", "+91-93-94"), ("(017)", "(93)"), ("192.168.0.1", "93.93.91.91"), ("me.you@mail3.example.com", "a.a@a91.a.a"),
        ("a1a1", "a91a91"), ("9999999999", "99"), ("12", "92"), ("x", "a"),
    ],
)
def test_shapes(word, want):
    assert pii_crf.shape(word) == want


def test_long_shapes_count_whole():
    one, two = "-".join("12" for _ in range(400)), "-".join("12" for _ in range(399)) + "-1"
    assert pii_crf.shape(one) != pii_crf.shape(two) and len(pii_crf.shape(one)) == 17


def test_words_under_many_spans_are_seen():
    cover = [(k, k + 1, 1) for k in range(9)] + [(9, 30, 2)]
    assert pii_crf._kind(cover, 0, 20, 22) == 2 and pii_crf._kind(cover, 0, 3, 4) == 1 and pii_crf._kind(cover, 0, 30, 31) == pii_crf.OTHER


def test_loopy_marginals_near_enumeration():
    """On a triangle of weak links the messages come close to the sums over all labellings."""
    import itertools

    k = len(pii_crf.LABELS)
    r = np.random.default_rng(4)
    own, near, far = r.normal(0, 1, (3, k)), r.normal(0, 0.2, (k, k)), r.normal(0, 0.2, (k, k))
    g = pii_crf.Graph([(0, 0, 1), (0, 2, 3), (0, 4, 5)], ["a", "b", "c"], np.full(3, pii_crf.OTHER), np.array([[0, 1], [1, 2]]), np.array([[0, 2]]))
    field = pii_crf.Field({s: own[i].tolist() for i, s in enumerate("abc")}, [0.0] * k, near.tolist(), far.tolist())
    exact = np.zeros((3, k))
    for y in itertools.product(range(k), repeat=3):
        p = np.exp(sum(own[i, y[i]] for i in range(3)) + near[y[0], y[1]] + near[y[1], y[2]] + far[y[0], y[2]])
        for i in range(3):
            exact[i, y[i]] += p
    assert np.abs(field.marginals(g) - exact / exact.sum(1, keepdims=True)).max() < 0.02


def test_a_document_settles_alike_beside_others():
    field = pii_crf.Field({}, [-2.0, -2.0, -0.7, -2.0, -0.7], np.zeros((5, 5)).tolist(), (3 * np.eye(5)).tolist())
    chain, other = "4111111111111111 " + "x 41-11111 " * 30, "5555 a@b.cd " * 40
    assert pii_crf.find([chain], field)[0] == pii_crf.find([other, chain, other], field)[1]


def test_cuts_in_long_words_change_no_gram(monkeypatch):
    text = "ab\u00e9" * 500 + " 12 " + "\u03a3" * 7 + "xyz" * 90
    whole = language_id.grams(text)
    for part in (1, 2, 7, 64):
        monkeypatch.setattr(language_id, "PART", part)
        assert all((a == b).all() for a, b in zip(language_id.grams(text), whole))


def test_distance_is_out_of_place():
    """Against a plain reckoning of the distance, over random profiles and texts."""
    import random

    r = random.Random(5)
    say = lambda: "".join(r.choice("abcde ") for _ in range(r.randint(1, 90)))
    for _ in range(40):
        ranked = {lang: language_id.top(*language_id.grams(say() + "a"), 30).tolist() for lang in "xyz"}
        text = say()
        keys, counts = language_id.grams(text)
        if not any(c.isalpha() for c in text):
            continue
        own = [k for _, k in sorted(zip((-counts).tolist(), keys.tolist()))][: language_id.TOP]
        far = {lang: sum(min(abs(i - p.index(k)), 30) if k in p else 30 for i, k in enumerate(own)) for lang, p in ranked.items()}
        best = min(far, key=lambda lang: (far[lang], lang))
        got = language_id.Profiles(ranked, 30).predict(text)
        assert got[0] == best and abs(got[1] - (1 - far[best] / (30 * len(own)))) < 1e-12


def test_stage_drops_what_is_near_to_no_profile(spark):
    docs = spark.createDataFrame([(0, "the cat and the dog and the hen " * 5, "en"), (1, "zxqj kvwq xzzq jjvk qqxz", "en"), (2, "the hen and the cat", "en")], "doc_id long, text string, lang string")
    ranked = language_id.learn(docs.where("doc_id = 0"))
    assert sorted(x.doc_id for x in language_id.recognised(docs, ranked, least=language_id.LEAST).collect()) == [0, 2]


def test_long_words_without_a_trie(monkeypatch):
    vocabulary = token_counts.Vocabulary({"a": -1.0, "ab": -1.5, "bab": -1.2, "\u2581": -0.5, "c": -3.0})
    words = ["\u2581" + "abcbab\u00e9" * n for n in (1, 3, 50)]
    want = token_counts.count(words, vocabulary)
    monkeypatch.setattr(token_counts, "LONG", 2)
    assert token_counts.count(words, vocabulary) == want
    monkeypatch.undo()
    assert token_counts.count(["\u2581" + "ab" * 1_000_000], vocabulary) == {"\u2581" + "ab" * 1_000_000: 1_000_001}


def test_slices_hold_every_row_once():
    texts = ["x" * n for n in (5, 0, 30, 1, 1, 100, 2)] + [None]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(8)), "text": texts})
    for limit in (1, 10, 31, 1000):
        parts = list(common.slices([batch, batch.slice(0, 0)], limit))
        assert sum((p.column("doc_id").to_pylist() for p, _ in parts), []) == list(range(8))
        assert sum((t for _, t in parts), []) == [t or "" for t in texts]


def test_blocks_in_one_scan(spark):
    docs = spark.createDataFrame([(i, f"say item number {i % 7} stands here in full and more words") for i in range(40)] + [(99, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, f"item number {k} stands here in full and") for k in range(7)], "item_id long, text string")
    one, many = (decontaminate.hits(docs, bench, rate=0.0, limit=n) for n in (10**6, 50))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect())) and one.count() == 40
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert decontaminate.clean(docs, bench, limit=50).select("doc_id").collect()[0][0] == 99
