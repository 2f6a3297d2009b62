import numpy as np

from flowgraph.llm import pii_crf

EQUAL = [[6.0 * (a == b) for b in range(5)] for a in range(5)]
NONE = [[0.0] * 5] * 5


def test_messages_reach_the_end_of_a_long_chain():
    """An observed card and 200 repeats of its last digits, each of which alone may as well be no card."""
    own = {pii_crf.shape("1111111"): [-20.0, -20.0, np.log(0.5), -20.0, np.log(0.5)]}
    text = " x ".join(["4111111111111111", *["1111111"] * 200])
    ((base, spans),) = pii_crf.find([text], pii_crf.Field(own, [0.0] * 5, NONE, EQUAL))
    assert len(base) == 1 and len(spans) == 201 and {k for k, *_ in spans} == {2}


def test_grouped_numbers_link_to_their_twins():
    """A phone number in groups, and a card in groups of four over two lines, after their whole twins."""
    own = {pii_crf.shape(w): [-3.0] * 4 + [-0.2] for w in ("555", "7713", "(017)")}
    field = pii_crf.Field(own, [-5.0] * 4 + [-0.03], NONE, EQUAL)
    words = " plain words " * 30
    for first, kind, twin, held in (("+1 (017) 555-7713", 3, "017 555 7713", ["555", "7713"]), ("4539 1488 0343 6467", 2, "4539 1488 \n x 0343 6467", ["0343", "6467"]), ("4539148803436467", 2, "4539-\n1488 -0343\n6467", ["-0343", "6467"])):
        text = first + words + twin + words
        ((base, spans),) = pii_crf.find([text], field)
        assert len(base) == 1
        found = [(k, text[a:b]) for k, a, b in spans if (k, a, b) not in base]
        assert [(kind, w) for w in held] == found[-2:], (first, found)
    assert pii_crf.find(["+1 (017) 555-7713" + words + "017 555 7714"], field)[0][1] == [(3, 0, 17)]


def test_repeated_groups_link_to_the_run_before():
    g = pii_crf.graph(["1111 1111 1111 1111 x 1111 1111 1111 1111"], [[]])
    assert g.skips.tolist() == [[3, 4], [3, 5], [3, 6], [3, 7]]


def test_learn_keeps_links_and_all_labels_of_a_shape(spark):
    """With room for one shape, seen mostly as no kind, its card label and the labels of links are kept."""
    texts = ["12 x 345 x " * 40, "mail a@b.cd now", "4111111111111111 x 4111111111111111"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    field, whole = pii_crf.learn(docs, shapes=1), pii_crf.learn(docs)
    assert (field.near, field.far) == (whole.near, whole.far)
    assert len(field.own) == 1 < len(whole.own) and all(v == whole.own[s] and v[2] > v[0] for s, v in field.own.items())
