import hashlib
import random
import re
from collections import Counter

import duckdb
import pytest

from flowgraph.llm import line_quality, pii_crf, token_counts

BLANK = r"[\x20\x09-\x0D]"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_quality(rows):
    frequent, hosts = Counter(), Counter()
    normal = lambda t: [x for x in (re.sub(BLANK + "+", " ", s).strip(" ") for s in (t or "").lower().split("\n")) if x]
    for _, t, _, s in rows:
        hosts[s] += 1
        for line in set(normal(t)):
            frequent[s, line] += 1
    for i, t, _, s in rows:
        text = t or ""
        words, lines = WORDS.findall(text), [x for x in text.split("\n") if WORDS.search(x)]
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        often = Counter(windows)
        repeated = {k + d for k, w in enumerate(windows) if often[w] > 1 for d in range(3)}
        lost = sum(len(x.split(" ")) for x in normal(t) if frequent[s, x] > line_quality.MIN_DOCS and frequent[s, x] > line_quality.SHARE * hosts[s])
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        yield (i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed, not failed and lost <= line_quality.LOSS * len(words), lost)


def quality_rows(odd_rows):
    r = random.Random(2)
    say = lambda n: " ".join(r.choice(["alpha", "Beta,", "g#m", "d", "é|x", "zed"]) + str(r.randrange(60)) for _ in range(n))
    common = ["Cookie  notice\tall rights 2020", say(70)]
    rows = list(odd_rows)
    for i in range(400):
        lines = [say(r.randint(1, 40)) for _ in range(r.randint(1, 5))]
        lines += r.choices(common, k=r.randint(0, 2)) + r.choices(lines, k=r.randint(0, 2)) + [" \t", ""] * r.randint(0, 1)
        r.shuffle(lines)
        rows.append((100 + i, r.choice(["\n", "\n", " \n"]).join(lines), "en", r.choice(["h1", "h1", "h2", None, ""])))
    rows.append((1000, "a a a a a b a a a " * 30, "en", "h1"))
    rows += [(2000, common[1] + "\nown " + say(20), "en", "h1")] * 3
    return rows


def test_quality_equals_brute_force(spark, docs_dir, odd_rows):
    rows = quality_rows(odd_rows)
    got = Counter(tuple(x) for x in line_quality.query(spark, docs_dir(rows)).collect())
    want = Counter(plain_quality(rows))
    assert got == want
    assert any(not x[-2] and not x[-3] for x in want)


def test_quality_equals_its_sql(spark, docs_dir, odd_rows):
    rows = list({r[0]: r for r in quality_rows(odd_rows) if r[0] is not None}.values())
    d = docs_dir(rows)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{d}/documents.parquet/*.parquet')")
    out = line_quality.query(spark, d)
    assert Counter(tuple(x) for x in out.collect()) == Counter(con.execute(f"select {', '.join(out.columns)} from ({line_quality.ORACLE_SQL})").fetchall())


def test_quality_runs_no_python(spark, docs_dir):
    out = line_quality.query(spark, docs_dir([]))
    assert out.count() == 0
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().toString())


def slow_tokens(word, vocabulary_scores, unknown):
    best = [(0.0, 0)] + [None] * len(word)
    for j in range(1, len(word) + 1):
        options = [(best[j - 1][0] + unknown, -(best[j - 1][1] + len(word[j - 1].encode())))]
        options += [(best[i][0] + vocabulary_scores[word[i:j]], -(best[i][1] + 1)) for i in range(j) if word[i:j] in vocabulary_scores]
        top = max(options)
        best[j] = top[0], -top[1]
    return best[-1][1]


def test_token_counts_equal_brute_force(spark, docs_dir, odd_rows):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=token_counts.default_path())
    scores = {model.id_to_piece(i): model.get_score(i) for i in range(259, model.get_piece_size())}
    unknown = min(scores.values()) - token_counts.UNKNOWN_PENALTY
    r = random.Random(4)
    rows = odd_rows + [(500 + i, " ".join("".join(r.choice("theranoisé漢.,") for _ in range(r.randint(1, 14))) for _ in range(40)), "en", "s") for i in range(20)]
    cache = {}
    want = Counter()
    for i, t, *_ in rows:
        words = WORDS.findall(t or "")
        if any(len(w) > 1000 for w in words):
            continue
        for w in set(words) - cache.keys():
            cache[w] = slow_tokens(token_counts.MARK + w, scores, unknown)
        want[i, len(words), sum(cache[w] for w in words)] += 1
    got = token_counts.query(spark, docs_dir(rows)).collect()
    assert len(got) == len(rows) and not want - Counter(tuple(x) for x in got)
    assert token_counts.query(spark, docs_dir([], "none")).count() == 0


def test_token_table_is_bounded():
    c = token_counts.Counter(token_counts.default_path(), keep=3)
    texts = ["the cat sat", "on the mat", "the cat sat on a mat again"]
    assert [c.texts([t])[0] for t in texts] == token_counts.Counter(token_counts.default_path()).texts(texts)


BASE = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            odd = [int(c) * 2 for c in digits[-2::-2]]
            luhn = (sum(map(int, digits[::-2])) + sum(x // 10 + x % 10 for x in odd)) % 10 == 0
            good = [True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True, 13 <= len(digits) <= 19 and luhn, 9 <= len(digits) <= 15][kind]
            if good:
                out.append((kind, *m.span()))
    return out


@pytest.fixture
def private_rows(odd_rows):
    r = random.Random(6)
    parts = ["a.b@c.de", "x@y", "p@q.r_s@t.u", "@@", "me@home.example.org.", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "01.002.3.4", "4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1112", "+1 (988) 555-2485", "(988) 555-2485", "+49 30 1234567", "+1", "123", "12-34", "word", "and", "é", "\n", "9" * 40]
    return odd_rows + [(3000 + i, "".join(r.choice(parts) + r.choice([" ", " ", "", ", "]) for _ in range(r.randint(1, 25))), "en", "s") for i in range(300)]


def test_base_spans_equal_the_patterns(private_rows):
    for _, t, *_ in private_rows:
        assert pii_crf.base_spans(t or "") == plain_spans(t or ""), t


def test_pii_query(spark, docs_dir, private_rows):
    got = {x.doc_id: x for x in pii_crf.query(spark, docs_dir(private_rows)).collect()}
    assert len(got) == len(private_rows)
    for i, t, *_ in private_rows:
        x, base = got[i], plain_spans(t or "")
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(s[0] == k for s in base) for k in range(4)]
        text = pii_crf.written(base)
        assert x.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(filter(None, x.spans.split(",")))
    assert pii_crf.query(spark, docs_dir([], "none")).count() == 0


def test_skip_links_carry_a_label_to_a_distant_twin():
    own = {pii_crf.shape(w): [-3.0] * 4 + [-0.2] for w in ("555-2485",)}
    far = [[6.0 * (a == b) - 3 for b in range(5)] for a in range(5)]
    field = pii_crf.Field(own, [-5.0] * 4 + [-0.03], [[0.0] * 5] * 5, far)
    words = "plain words " * 30
    both = f"+1 (988) 555-2485 {words} (988) 555-2485 end"
    alone = f"{words} 555-2485 end"
    (base, spans), (none, nothing) = pii_crf.find([both, alone], field)
    assert base == plain_spans(both) and none == nothing == []
    at = both.rindex("555-2485")
    assert (3, at, at + 8) in spans


def test_marginals_equal_enumeration_on_a_tree():
    import itertools

    import numpy as np

    r = np.random.default_rng(0)
    field = pii_crf.Field({str(i): r.normal(size=5).tolist() for i in range(4)}, [0.0] * 5, r.normal(size=(5, 5)).tolist(), r.normal(size=(5, 5)).tolist())
    g = pii_crf.Graph([(0, i, i) for i in range(4)], list("0123"), np.array([4, 4, 1, 4]), np.array([[0, 1], [1, 2]]), np.array([[1, 3]]))
    p = np.zeros((4, 5))
    for y in itertools.product(range(5), repeat=4):
        if y[2] == 1:
            s = sum(field.own[str(i)][y[i]] for i in (0, 1, 3)) + sum(field.near[y[a]][y[b]] for a, b in g.next_to) + field.far[y[1]][y[3]]
            for i in range(4):
                p[i, y[i]] += np.exp(s)
    assert np.allclose(field.marginals(g), p / p.sum(axis=1, keepdims=True), atol=1e-3)


def test_redact_keeps_rows_and_columns(spark):
    rows = [(1, "mail a.b@c.de now", 17, "x"), (2, None, None, "y"), (3, "clean", 5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    field = pii_crf.learn(docs)
    out = sorted(tuple(x) for x in pii_crf.redact(docs, field).collect())
    assert out == [(1, "mail [email] now", 16, "x"), (2, None, None, "y"), (3, "clean", 5, None)]
