"""Personal data by base patterns and a skip-chain conditional random field.

Base patterns find e-mail addresses, IP addresses, card numbers and phone numbers over each whole text. The field then
labels every word that holds a digit or an at sign (plain words can only be O), with three kinds of potentials:
a word's own, by its shape; a link to the next such word if nothing stands between; and skip links between distant
words of a document that repeat or resemble each other: the same digits, in one word or in neighbouring ones, or the
same mailbox or host. Words inside base spans are observed. Loopy sum-product message passing runs over all documents of a slice at once until messages
settle; a word that then holds a kind with at least SURE becomes a span, so that a number or address that a pattern
misses gets the label of its twin.

The potentials are trained piecewise, each factor by the smoothed log ratios of its labels, on base spans as labels,
from about LEARN documents drawn by hash. A resemblance links each word to the one before it with the same key, so
links grow with the words and not with their pairs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgraph.llm.common import documents, let_go, slices

KINDS = ("email", "ip", "card", "phone")
LABELS = (*KINDS, "O")
OTHER = len(KINDS)
LEARN = 20_000
SHAPE_CHARS = 24
SURE = 0.6
#: A safety limit for messages that swing and never settle: so many rounds, and so many more a link of their document.
ROUNDS = 1000
ROUNDS_A_LINK = 8
SETTLED = 1e-4
SMOOTH = 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A run of digits is taken whole or not at all, so a start inside one can't match where its first digit doesn't.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NO_DIGIT = re.compile("[^0-9]+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LETTER = re.compile(r"[^\W\d_]")
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile("[0-9]+")
_EDGES = "\"'`,;:!?<>[]{}=.*"

Span = tuple[int, int, int]


def emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (host := _HOST.match(text, at + 1)):
            end = host.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) by kind, then start."""
    out: list[Span] = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text) if "." in text else ():
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _NO_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def shape(word: str) -> str:
    """Runs of letters as a, then runs of digits as 9 with their length up to 9, the rest as it is; a long shape as a digest of all of it."""
    out = _DIGITS.sub(lambda m: f"9{min(len(m[0]), 9)}", _LETTERS.sub("a", word))
    return out if len(out) <= SHAPE_CHARS else "#" + hashlib.blake2b(out.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def keys(word: str) -> list[str]:
    """What a word shares with those that resemble it: its digits from six on, its mailbox and host, its last seven digits."""
    digits, out = _NO_DIGIT.sub("", word), []
    if len(digits) >= 6:
        out.append(f"d{digits[-7:]}")
    if "@" in word:
        box, _, host = word.strip(_EDGES).lower().rpartition("@")
        out += [f"m{box}"] * bool(box) + [f"m{box}@{host}"] * bool(box)
    elif digits and "." in word and re.search("[a-z]", word):
        out.append(f"m{word.strip(_EDGES).lower()}")
    return out


def joint(run: list[tuple[int, str]]) -> tuple[str, list[int]]:
    """The key of the last seven digits of neighbouring numbers (word, digits), and the words that hold them; "" for one word."""
    digits, held = "", []
    for n, own in reversed(run):
        if len(digits) >= 7:
            break
        digits, held = own + digits, [n, *held]
    return (f"d{digits[-7:]}" if len(held) > 1 and len(digits) >= 6 else ""), held


def _kind(cover: list[Span], at: int, start: int, end: int) -> int:
    """The kind of the first span (start, end, kind), from place `at` on, that meets the word, or OTHER."""
    while at < len(cover) and cover[at][0] < end:
        if cover[at][1] > start:
            return cover[at][2]
        at += 1
    return OTHER


@dataclass
class Graph:
    """The field of a slice of documents; links are rows (word, word), tokens are (document, start, end)."""

    tokens: list[tuple[int, int, int]]
    shapes: list[str]
    seen: np.ndarray
    next_to: np.ndarray
    skips: np.ndarray


def graph(texts: list[str], found: list[list[Span]]) -> Graph:
    tokens, shapes, seen, near, far = [], [], [], [], []
    for d, (text, spans) in enumerate(zip(texts, found, strict=True)):
        if not ("@" in text or _DIGIT.search(text)):
            continue
        cover = sorted((a, b, k) for k, a, b in spans)
        last_of: dict[str, int] = {}
        run: list[tuple[int, str]] = []
        joined: dict[str, int] = {}
        tied: set[tuple[int, int]] = set()
        at, before = 0, -1
        for m in _WORD.finditer(text):
            word, (start, end) = m[0], m.span()
            number = "@" not in word and bool(_DIGIT.search(word)) and not _LETTER.search(word)
            if run and not number:
                far += sorted(tied)
                last_of |= joined
                run, joined, tied = [], {}, set()
            if "@" not in word and not _DIGIT.search(word):
                before = -1
                continue
            while at < len(cover) and cover[at][1] <= start:
                at += 1
            n = len(tokens)
            tokens.append((d, start, end))
            shapes.append(shape(word))
            seen.append(_kind(cover, at, start, end))
            if before >= 0:
                near.append((before, n))
            before = n
            for key in keys(word):
                if key in last_of:
                    far.append((last_of[key], n))
                last_of[key] = n
            if number:
                run = [*run[-6:], (n, _NO_DIGIT.sub("", word))]
                key, held = joint(run)
                if key:
                    tied |= {(last_of[key], w) for w in held if last_of.get(key, w) < held[0]}
                    joined[key] = n
        far += sorted(tied)
    pairs = lambda x: np.array(x, np.int64).reshape(-1, 2)
    return Graph(tokens, shapes, np.array(seen, np.int64), pairs(near), pairs(far))


@dataclass
class Field:
    """Log potentials: own by shape, and tables of label pairs for neighbours and skip links."""

    own: dict[str, list[float]]
    unseen: list[float]
    near: list[list[float]]
    far: list[list[float]]

    def marginals(self, g: Graph) -> np.ndarray:
        """Loopy sum-product over the graph; observed words hold their label. Rows are words, columns LABELS.

        A round works out only messages that still move or whose source was told something new, until none is left.
        """
        n, k = len(g.tokens), len(LABELS)
        own = np.array([self.own.get(s, self.unseen) for s in g.shapes], float).reshape(n, k)
        held = np.flatnonzero(g.seen != OTHER)
        own[held] = -50.0
        own[held, g.seen[held]] = 0.0
        links = np.concatenate([g.next_to, g.skips])
        table = np.concatenate([np.repeat(np.array(t, float)[None], len(e), 0) for t, e in ((self.near, g.next_to), (self.far, g.skips))])
        src, dst = np.concatenate([links[:, 0], links[:, 1]]), np.concatenate([links[:, 1], links[:, 0]])
        table = np.concatenate([table, table.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(links)) + len(links), np.arange(len(links))])
        told = np.zeros((len(src), k))
        belief = own.copy()
        moving, turn = np.arange(len(src)), 0
        document = np.array([t[0] for t in g.tokens], np.int64)[src] if n else src
        most = ROUNDS + ROUNDS_A_LINK * np.bincount(document, minlength=1)[document] // 2
        while len(moving := moving[most[moving] > turn]):
            rest = belief[src[moving]] - told[back[moving]]
            new = np.logaddexp.reduce(rest[:, :, None] + table[moving], axis=1)
            new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
            step = 0.5 * (new - told[moving]) if turn else new
            told[moving] += step
            np.add.at(belief, dst[moving], step)
            far = moving[np.abs(step).max(axis=1) >= SETTLED]
            touched = np.zeros(n, bool)
            touched[dst[far]] = True
            again = touched[src]
            again[far] = True
            moving, turn = np.flatnonzero(again), turn + 1
        return np.exp(belief - np.logaddexp.reduce(belief, axis=1, keepdims=True))


def find(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text; an added span is a word without the marks around it, and touches no other span."""
    found = [base_spans(t) for t in texts]
    g = graph(texts, found)
    more: dict[int, list[Span]] = {}
    if len(g.tokens):
        p = field.marginals(g)
        label = p.argmax(axis=1)
        for n in np.flatnonzero((g.seen == OTHER) & (label != OTHER) & (p.max(axis=1) >= SURE)).tolist():
            d, start, end = g.tokens[n]
            word = texts[d][start:end]
            start += len(word) - len(word.lstrip(_EDGES))
            end -= len(word) - len(word.rstrip(_EDGES))
            if start < end and all(b <= start or a >= end for _, a, b in found[d]):
                more.setdefault(d, []).append((int(label[n]), start, end))
    return [(base, sorted(base + more[d]) if d in more else base) for d, base in enumerate(found)]


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (factor, value, labels): shapes with a label, and links with both their labels."""
    let_go()
    for _, texts in slices(batches):
        g = graph(texts, [base_spans(t) for t in texts])
        counts: dict[tuple[str, str, int, int], int] = {}
        for s, y in zip(g.shapes, g.seen.tolist(), strict=True):
            counts["own", s, y, 0] = counts.get(("own", s, y, 0), 0) + 1
        for name, links in (("near", g.next_to), ("far", g.skips)):
            for a, b in g.seen[links].tolist():
                counts[name, "", a, b] = counts.get((name, "", a, b), 0) + 1
        if counts:
            names = ("factor", "value", "a", "b")
            columns = [pa.array(c) for c in zip(*counts, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(counts.values()), pa.int64())], [*names, "n"])


def learn(docs: DataFrame, most: int = LEARN, shapes: int | None = None) -> Field:
    """Trains the field on about `most` rows of docs (doc_id, text), with all shapes in them, or the first `shapes`:
    those seen with a kind before others, then by frequency.

    What comes to the driver are counts of links, 50 rows at most, and of the shapes in those rows, apart from shapes
    seen once and as no kind: these tell no more than the prior for unseen ones does.
    """
    share = min(1.0, most / max(1, docs.select("doc_id").count()))
    chance = F.pmod(F.xxhash64(F.lit(5), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    rows = docs.where(chance < share).select("text").mapInArrow(_counter, "factor string, value string, a long, b long, n long")
    counts = rows.groupBy("factor", "value", "a", "b").agg(F.sum("n").alias("n"))
    counts = counts.where((F.col("factor") != "own") | (F.col("a") != OTHER) | (F.col("n") > 1)).collect()
    k = len(LABELS)
    own: dict[str, np.ndarray] = {}
    tables = {"near": np.zeros((k, k)), "far": np.zeros((k, k))}
    if shapes is not None:
        seen: dict[str, tuple[bool, int]] = {}
        for _, value, a, _, n in (r for r in counts if r.factor == "own"):
            kind, often = seen.get(value, (False, 0))
            seen[value] = kind or a != OTHER, often + n
        first = set(sorted(seen, key=lambda v: (not seen[v][0], -seen[v][1], v))[:shapes])
        counts = [r for r in counts if r.factor != "own" or r.value in first]
    for factor, value, a, b, n in sorted(counts):
        if factor == "own":
            own.setdefault(value, np.zeros(k))[a] += n
        else:
            tables[factor][a, b] += n
    prior = np.where(np.arange(k) == OTHER, 0.9, 0.1 / (k - 1))

    def logs(x: np.ndarray) -> list[float]:
        return np.log((x + SMOOTH * prior) / (x.sum() + SMOOTH)).tolist()

    def ratios(x: np.ndarray, agree: float) -> list[list[float]]:
        """How much likelier each pair of labels is than by chance; without counts, equal labels are by `agree`."""
        x = x + x.T + SMOOTH * (np.full((k, k), 1.0) + (agree - 1) * np.eye(k))
        p = x / x.sum()
        return np.clip(np.log(p / np.outer(p.sum(1), p.sum(0))), -6, 6).tolist()

    return Field({s: logs(v) for s, v in own.items()}, logs(np.zeros(k)), ratios(tables["near"], 1.0), ratios(tables["far"], 50.0))


def _query(field: Field) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            out = find(texts, field)
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in out], pa.int64()) for k in range(len(KINDS))]
            digests = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in out])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, digests, pa.array([written(s) for _, s in out], pa.string())], names)

    return run


def detect(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of each row of docs (doc_id long, text string).

    Counts and digest are those of base spans, spans holds the field's as well. Null and empty texts have none;
    repeated rows, ids and null ids give a row each; other columns are ignored; an empty table gives no rows.
    """
    shape = "doc_id long, " + "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(_query(field), shape)


def redacted(text: str, spans: list[Span]) -> str:
    """text with each span as its kind in brackets; of overlapping ones the first start holds, then the longer."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """docs, all rows and columns, with spans in text replaced, and n_chars, where there, as the new length.

    A null text stays null. A span that another one overlaps goes with it.
    """
    schema, names = docs.schema, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            null = batch.column("text").is_null().to_pylist()
            new = [None if no else redacted(t, s) if s else t for no, t, (_, s) in zip(null, texts, find(texts, field), strict=True)]
            columns = dict(zip(names, batch.columns, strict=True))
            columns["text"] = pa.array(new, columns["text"].type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in new], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return detect(docs, learn(docs))
