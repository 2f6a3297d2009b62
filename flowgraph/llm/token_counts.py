"""Token counts by dynamic programming over a trie of distinct pre-tokens.

A pre-token is a word `[^\\x20\\x09-\\x0D]+` with the mark U+2581 before it. Its tokens are the pieces of the best
segmentation under a unigram model: the scores of its pieces sum up highest, and of equals it has the fewest pieces.
A character outside the vocabulary stands alone, at a score below every piece's, and counts its UTF-8 bytes.

A batch's distinct new pre-tokens are inserted in a trie. A node's forward state - best score, fewest tokens, and the
vocabulary paths still open at that character - is computed once from its parent's, so words that share a prefix
share its work; terminal nodes store their counts. Counts of seen pre-tokens are kept in a bounded table.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from flowgraph.llm.common import documents, kept, slices

MARK = "▁"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
KEEP = 300_000
#: Longer words share no prefix worth a trie and are walked alone, with the open paths as all their memory.
LONG = 256
UNKNOWN_PENALTY = 10.0


class Vocabulary:
    """A trie of pieces; a node is a dict of its next characters, with the piece's score under the empty string."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.root: dict = {}
        for piece, score in scores.items():
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = score
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY


def load(path: str) -> Vocabulary:
    """The ordinary pieces of a sentencepiece file with their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kinds = (model.is_control, model.is_unknown, model.is_unused, model.is_byte)
    ids = [i for i in range(model.get_piece_size()) if not any(k(i) for k in kinds)]
    return Vocabulary({model.id_to_piece(i): model.get_score(i) for i in ids})


def insert(words: Iterable[str]) -> dict:
    """A trie of the words; a node's word stands under the empty string."""
    root: dict = {}
    for word in words:
        node = root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = word
    return root


def _step(c: str, best: float, tokens: int, paths: tuple | list, vocabulary: Vocabulary) -> tuple[float, int, list]:
    """The forward state after one more character: best score, fewest tokens, and vocabulary paths still open."""
    top, fewest, still = best + vocabulary.unknown, tokens + len(c.encode("utf-8", "surrogatepass")), []
    for path, score, n in (*paths, (vocabulary.root, best, tokens)):
        if (path := path.get(c)) is not None:
            if len(path) > 1 or "" not in path:
                still.append((path, score, n))
            if (own := path.get("")) is not None:
                own += score
                if own > top or (own == top and n + 1 < fewest):
                    top, fewest = own, n + 1
    return top, fewest, still


def count(words: Iterable[str], vocabulary: Vocabulary) -> dict[str, int]:
    """The number of tokens of each distinct word, which carries its mark."""
    out: dict[str, int] = {}
    short = []
    for word in words:
        if len(word) <= LONG:
            short.append(word)
            continue
        state = 0.0, 0, []
        for c in word:
            state = _step(c, *state, vocabulary)
        out[word] = state[1]
    #: A trie node with its forward state: best score, tokens, open vocabulary paths with the state they began at.
    todo = [(insert(short), 0.0, 0, [])]
    while todo:
        node, best, tokens, paths = todo.pop()
        for c, below in node.items():
            if c:
                todo.append((below, *_step(c, best, tokens, paths, vocabulary)))
            else:
                out[below] = tokens
    return out


class Counter:
    def __init__(self, path: str, keep: int = KEEP) -> None:
        self.vocabulary, self.keep, self.known = load(path), keep, {}

    def texts(self, texts: list[str]) -> list[tuple[int, int]]:
        """(words, tokens) of each text."""
        if len(self.known) > self.keep:
            self.known = {}
        found = [WORD.findall(t) for t in texts]
        new = {w for words in found for w in words}.difference(self.known)
        for word, n in count([MARK + w for w in new], self.vocabulary).items():
            self.known[word[1:]] = n
        known = self.known.__getitem__
        return [(len(words), sum(map(known, words))) for words in found]


def counter(path: str) -> Counter:
    return kept(Counter, path)


def _run(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            rows = counter(path).texts(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1))], ["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens of each row of docs (doc_id long, text string).

    Null, empty and blank texts have 0 words and tokens; repeated rows and ids, and null ids, give a row each; other
    columns are ignored; an empty table gives no rows.
    """
    return docs.select("doc_id", "text").mapInArrow(_run(path), "doc_id long, n_words long, n_tokens long")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), default_path())
