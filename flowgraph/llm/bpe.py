"""Token ids of whole texts by a byte-level BPE file of the tokenizers library.

The library cuts a text into words before it merges bytes, so a word's ids do not depend on what stands around it.
Here texts are cut by the same rule, each distinct word is encoded by the library, and the ids of frequent words are
kept in a bounded table. The rule is written for characters that both regex engines class alike (SURE); a text with
any other character, or with a special token's string, goes to the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

from flowgraph.llm.common import kept

#: The pre-tokenizer's rule, with letters as [^\W\d_], for texts in SURE.
WORD = re.compile(r" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: The same rule as it reads for ASCII texts.
ASCII_WORD = re.compile(r" ?[A-Za-z]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[!-/:-@\[-`{-~]+|\s+(?!\S)|\s+")
UNSURE = re.compile("[^\t-\r -~¡-±´-¸º»¿-ɏЀ-ҁҊ-ӿぁ-ゖァ-ヺ一-龥가-힣‐-‗‘-‧‰-⁞€]")
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
LONG = 500_000
#: Characters to encode at a time; the table's upkeep costs the same for few or many.
SLICE = 1_000_000


class _Codes(dict):
    """Gives each new word the next number and remembers that it is to be encoded."""

    def __init__(self, words: list[str] = ()) -> None:
        super().__init__(zip(words, range(len(words)), strict=True))
        self.pending: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        self.pending.append(word)
        return code


class Encoder:
    """encode(texts) gives all ids in a row and the number of each text's ids."""

    def __init__(self, path: str, keep: int = 400_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.newline = self._library("\n")
        self.codes, self.uses = _Codes(), np.zeros(0, np.int64)
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    @property
    def vocab_size(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _odd(self, text: str) -> bool:
        return UNSURE.search(text) is not None or any(s in text for s in self.special)

    def _trim(self) -> None:
        """Keeps the words used most, half the table at most, and forgets half of their uses."""
        half = self.keep // 2
        least = max(1, int(np.partition(self.uses, -half)[-half])) if len(self.uses) > half else 0
        kept = np.flatnonzero(self.uses > least)
        words = list(self.codes)
        sizes = np.diff(self.ends)[kept]
        self.ids, self.ends = self._gather(kept, sizes), np.concatenate([[0], np.cumsum(sizes)])
        self.codes, self.uses = _Codes([words[i] for i in kept.tolist()]), self.uses[kept] // 2

    def _gather(self, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.ends[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]

    def _words(self, text: str) -> list[str]:
        if self._odd(text):
            return [text]
        rule = ASCII_WORD if text.isascii() else WORD
        if len(text) <= LONG:
            return rule.findall(text)
        out, at = [], 0
        while at < len(text):
            cut = SAFE_CUT.search(text, min(at + LONG, len(text)))
            end = cut.start() if cut else len(text)
            out += rule.findall(text[at:end])
            at = end
        return out

    def _encode_new(self) -> None:
        """Words without a line break go to the library together, a line each: a line break is always a word of its own."""
        new, self.codes.pending = self.codes.pending, []
        alone = {k: self._library(w) for k, w in enumerate(new) if w.isspace() or self._odd(w) or "\n" in w or "\r" in w}
        together = self._library("\n".join([w for k, w in enumerate(new) if k not in alone] if alone else new) + "\n")
        breaks = np.flatnonzero(together == self.newline[0])
        if alone:
            rest = iter(np.split(together, breaks + 1))
            found = [alone[k] if k in alone else next(rest)[:-1] for k in range(len(new))]
            flat, sizes = np.concatenate(found), np.array([len(x) for x in found])
        else:
            flat, sizes = np.delete(together, breaks), np.diff(breaks, prepend=-1) - 1
        self.ids = np.concatenate([self.ids, flat])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.codes) > self.keep:
            self._trim()
        code, codes, counts = self.codes.__getitem__, [], []
        for text in texts:
            words = self._words(text) if text else []
            counts.append(len(words))
            codes += map(code, words)
        if self.codes.pending:
            self._encode_new()
        at = np.fromiter(codes, np.int64, len(codes))
        self.uses += np.bincount(at, minlength=len(self.uses))
        sizes = self.ends[at + 1] - self.ends[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return self._gather(at, sizes), np.diff(ends[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)])


def encoder(path: str) -> Encoder:
    """One per Python worker; its table lives on from task to task."""
    return kept(Encoder, path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
