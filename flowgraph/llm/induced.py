"""Suffix arrays by induced sorting, and permuted common prefixes, over numpy arrays.

Suffixes are classified as smaller (S) or larger (L) than the next; an S after an L is a leftmost smaller one. Their
substrings are sorted by inducing, named, and the string of names is sorted in turn. From their order the L suffixes
are induced left to right and the S suffixes right to left, each pass linear. A pass takes a bucket at a time: what a
run of the bucket induces is placed at once, and what lands in the same bucket is its next run.

A string of names is sorted by the same procedure while its alphabet is small; where there are about as many names
as places, buckets hold nothing to induce together and the names are ranked by doubling their length instead.
"""

from __future__ import annotations

import numpy as np

SMALL = 1 << 8
STEP = 128


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True for S; the end counts as smaller than any symbol, so the last suffix is L."""
    change = np.flatnonzero(text[1:] != text[:-1])
    rises = text[change + 1] > text[change]
    runs = np.diff(np.concatenate([[-1], change, [len(text) - 1]]))
    return np.repeat(np.append(rises, False), runs)


def _induce(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    """The suffix array that the sorted leftmost smaller suffixes in seeds induce."""
    n = len(text)
    counts = np.bincount(text, minlength=size)
    ends = np.cumsum(counts)
    starts = ends - counts
    #: Whether the place before is to be induced; the first one has none.
    larger_before, smaller_before = np.append(False, ~smaller[:-1]), np.append(False, smaller[:-1])
    sa = np.full(n, -1, np.int32)
    heads, tails = starts.copy(), ends.copy()
    seeds = seeds.astype(np.int32)
    seed_at = np.searchsorted(text[seeds], np.arange(size + 1))

    def place(at: np.ndarray, low: bool) -> None:
        """Puts the suffixes `at`, in the order that they were found, at the heads or tails of their buckets."""
        symbols = text[at]
        order = np.argsort(symbols, kind="stable")
        sorted_symbols = symbols[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_symbols[1:] != sorted_symbols[:-1]]))
        counts = np.diff(np.append(first, len(at)))
        bucket = sorted_symbols[first]
        if low:
            sa[np.repeat(heads[bucket] - first, counts) + np.arange(len(at))] = at[order]
            heads[bucket] += counts
        else:
            sa[np.repeat(tails[bucket] - 1 + first, counts) - np.arange(len(at))] = at[order]
            tails[bucket] -= counts

    def before(run: np.ndarray, kind: np.ndarray) -> np.ndarray:
        return run[kind[run]] - 1

    place(np.array([n - 1], np.int32), True)
    present = np.flatnonzero(ends > starts)
    for c in present.tolist():
        done = starts[c]
        while done < heads[c]:
            run = sa[done : heads[c]].copy()
            done = heads[c]
            if len(at := before(run, larger_before)):
                place(at, True)
        if len(at := before(seeds[seed_at[c] : seed_at[c + 1]], larger_before)):
            place(at, True)
    for c in present[::-1].tolist():
        done = ends[c]
        while done > tails[c]:
            run = sa[tails[c] : done][::-1].copy()
            done = tails[c]
            if len(at := before(run, smaller_before)):
                place(at, False)
        if len(at := before(sa[starts[c] : heads[c]][::-1], smaller_before)):
            place(at, False)
    return sa


def _doubled(names: np.ndarray, size: int) -> np.ndarray:
    """Ranks of the suffixes of a string of names, by ranking ever longer stretches of those that are still tied."""
    n, span = len(names), 1
    counts = np.bincount(names, minlength=size)
    rank = (np.cumsum(counts) - counts)[names]
    tied = np.flatnonzero(counts[names] > 1)
    while len(tied):
        follow = np.where(tied + span < n, rank[np.minimum(tied + span, n - 1)] + 1, 0)
        order = np.argsort(rank[tied] * np.int64(n + 1) + follow)
        tied, follow = tied[order], follow[order]
        old = rank[tied]
        group = np.append(True, old[1:] != old[:-1])
        part = group | np.append(True, follow[1:] != follow[:-1])
        place = np.arange(len(tied))
        first = np.maximum.accumulate(np.where(part, place, 0))
        rank[tied] = old + first - np.maximum.accumulate(np.where(group, place, 0))
        alone = part & np.append(part[1:], True)
        tied, span = tied[~alone], 2 * span
    return rank


def suffix_array(text: np.ndarray, size: int) -> np.ndarray:
    """Starts of the suffixes of text (symbols 0 to size - 1) in their order; the end is smaller than any symbol."""
    n = len(text)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    #: Small symbols sort by radix, and everything takes half the room in 32 bits.
    text = text.astype(np.uint8 if size <= 1 << 8 else np.uint16 if size <= 1 << 16 else np.int32, copy=False)
    smaller = suffix_types(text)
    lms = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)
    if len(lms) < 2:
        return _induce(text, smaller, lms, size)
    first = lms[np.argsort(text[lms], kind="stable")]
    order = _induce(text, smaller, first, size)
    is_lms = np.zeros(n + 1, bool)
    is_lms[lms] = True
    ranked = order[is_lms[order]]
    names = _names(text, lms, ranked)
    count = int(names.max()) + 1
    if count < len(lms):
        if count <= SMALL:
            sorted_lms = suffix_array(names, count)
        else:
            sorted_lms = np.argsort(_doubled(names, count), kind="stable")
        return _induce(text, smaller, lms[sorted_lms], size)
    return _induce(text, smaller, ranked, size)


def _names(text: np.ndarray, lms: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    """Numbers the leftmost smaller substrings in text order: equal ones alike, ascending in the order of ranked."""
    number = np.empty(len(text), np.int32)
    number[lms] = np.arange(len(lms), dtype=np.int32)
    index = number[ranked]
    end = np.append(lms[1:], len(text) - 1)
    size = (end - lms + 1)[index]
    same = size[1:] == size[:-1]
    #: The last one ends with the string, so it equals no other.
    same &= (index[1:] != len(lms) - 1) & (index[:-1] != len(lms) - 1)
    open_, k = np.flatnonzero(same), 0
    while len(open_):
        open_ = open_[size[open_] > k]
        differ = text[ranked[open_] + k] != text[ranked[open_ + 1] + k]
        same[open_[differ]] = False
        open_ = open_[~differ]
        k += 1
    names = np.empty(len(lms), np.int32)
    names[index] = np.concatenate([[0], np.cumsum(~same)])
    return names


def common_prefixes(text: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Permuted: for each place, how much its suffix shares with the one before it in order, exact up to `most`.

    Where the symbols before both are equal, the prefix is one less than that of the place before; only the others,
    and every STEP-th place, are compared, seven symbols at a time and STEP further than asked for.
    """
    n, limit = len(text), most + STEP
    phi = np.full(n, -1, np.int32)
    phi[sa[1:]] = sa[:-1]
    derived = np.zeros(n, bool)
    at = np.flatnonzero(phi[1:] > 0).astype(np.int32) + 1
    derived[at] = text[at - 1] == text[phi[at] - 1]
    derived[::STEP] = False
    open_ = np.flatnonzero((phi >= 0) & ~derived).astype(np.int32)
    #: Seven symbols of 9 bits a word; 0 is past the end.
    one = np.zeros(n + limit + 16, np.uint64)
    one[:n] = text
    one[:n] += np.uint64(1)
    words = one.copy()
    words[:-1] |= one[1:] << np.uint64(9)
    seven = words.copy()
    seven[:-2] |= words[2:] << np.uint64(18)
    seven[:-4] |= words[4:] << np.uint64(36)
    seven[:-6] |= one[6:] << np.uint64(54)
    shared, k, other = np.zeros(n, np.int32), 0, phi[open_]
    while len(open_) and k < limit:
        differ = seven[open_ + k] ^ seven[other + k]
        same = differ == 0
        #: The lowest bit that differs, read as a power of two, is in the first symbol that does.
        bit = differ[~same]
        bit = ((bit & (~bit + np.uint64(1))).astype(np.float64).view(np.int64) >> 52) - 1023
        shared[open_[~same]] = k + bit // 9
        open_, other = open_[same], other[same]
        k += 7
        shared[open_] = k
    place = np.arange(n, dtype=np.int32)
    base = np.where(derived, 0, place).astype(np.int32)
    np.maximum.accumulate(base, out=base)
    return np.maximum(shared[base] - (place - base), 0)
