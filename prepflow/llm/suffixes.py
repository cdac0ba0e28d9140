"""Suffix arrays by induced sorting and permuted common prefixes, in numpy.

Suffixes are smaller (S) or larger (L) than their successor. The leftmost smaller ones are sorted by their
substrings, named and, if names repeat, sorted recursively; all others follow from them in two passes over the
buckets of first characters. Within a bucket whole generations are placed at once. Where the alphabet is large,
as in the recursion, the passes go from suffix to suffix instead.
"""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are induced bucket by bucket.
SMALL_ALPHABET = 1024


def smaller_types(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last character is the only smallest."""
    n = len(s)
    differs = np.append(s[:-1] != s[1:], True)
    at = np.where(differs, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    after = np.minimum(at + 1, n - 1)
    types = s[at] < s[after]
    types[-1] = True
    return types


def place(sa: np.ndarray, free: np.ndarray, found: np.ndarray, chars: np.ndarray, step: int) -> None:
    """Put suffixes at the free ends of their buckets, in order; ``step`` is the direction in which buckets fill."""
    order = np.argsort(chars, kind="stable")
    found, chars = found[order], chars[order]
    first = np.concatenate(([0], np.flatnonzero(chars[1:] != chars[:-1]) + 1))
    sizes = np.diff(np.append(first, len(chars)))
    within = np.arange(len(chars)) - np.repeat(first, sizes)
    sa[free[chars] + step * within] = found
    free[chars[first]] += step * sizes


def induce(s: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    """Sort all suffixes, given the leftmost smaller ones in order (or in any order, to sort their substrings)."""
    if size > SMALL_ALPHABET:
        return induce_each(s, smaller, seeds, size)
    n = len(s)
    ends = np.cumsum(np.bincount(s, minlength=size))
    starts = ends - np.bincount(s, minlength=size)
    seeds = seeds[np.argsort(s[seeds], kind="stable")]
    seed_at = np.searchsorted(s[seeds], np.arange(size + 1))
    sa = np.zeros(n, np.int64)

    def push(group: np.ndarray, kind: bool, free: np.ndarray, step: int) -> None:
        before = group[group > 0] - 1
        before = before[smaller[before] == kind]
        if len(before):
            place(sa, free, before, s[before], step)

    head = starts.copy()
    for c in range(size):
        done = starts[c]
        while done < head[c]:
            group, done = sa[done : head[c]].copy(), head[c]
            push(group, False, head, 1)
        push(seeds[seed_at[c] : seed_at[c + 1]], False, head, 1)
    tail = ends - 1
    sa[tail[0]] = n - 1
    tail[0] -= 1
    for c in range(size - 1, 0, -1):
        done = ends[c] - 1
        while done > tail[c]:
            group, done = sa[tail[c] + 1 : done + 1][::-1].copy(), tail[c]
            push(group, True, tail, -1)
        push(sa[starts[c] : head[c]][::-1], True, tail, -1)
    return sa


def induce_each(s: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    counts = np.bincount(s, minlength=size)
    ends = np.cumsum(counts)
    text, kind = s.tolist(), smaller.tolist()
    sa = [-1] * len(text)
    tail = (ends - 1).tolist()
    for i in seeds[::-1].tolist():
        sa[tail[text[i]]] = i
        tail[text[i]] -= 1
    head = (ends - counts).tolist()
    for k in range(len(sa)):
        i = sa[k] - 1
        if i >= 0 and not kind[i]:
            sa[head[text[i]]] = i
            head[text[i]] += 1
    tail = (ends - 1).tolist()
    for k in range(len(sa) - 1, -1, -1):
        i = sa[k] - 1
        if i >= 0 and kind[i]:
            sa[tail[text[i]]] = i
            tail[text[i]] -= 1
    return np.array(sa, np.int64)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of integers from 1 on that ends in a single 0."""
    n, size = len(s), int(s.max()) + 1
    if n < 3:
        return np.arange(n)[::-1].copy()
    smaller = smaller_types(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    rough = induce(s, smaller, lms, size)
    rough = rough[is_lms[rough]]
    names = np.empty(n, np.int64)
    names[rough] = np.cumsum(new_names(s, lms, rough)) - 1
    reduced = names[lms]
    if reduced.max() + 1 == len(lms):
        order = rough
    else:
        order = lms[suffix_array(reduced)]
    return induce(s, smaller, order, size)


def new_names(s: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether each substring between leftmost smaller suffixes, in order, differs from the one before."""
    size = np.zeros(len(s), np.int64)
    size[lms] = np.diff(np.append(lms, len(s) - 1)) + 1
    length = size[order]
    differs = np.ones(len(order), bool)
    differs[1:] = length[1:] != length[:-1]
    open_ = np.flatnonzero(~differs)
    offset = 0
    while len(open_):
        unequal = s[order[open_] + offset] != s[order[open_ - 1] + offset]
        differs[open_[unequal]] = True
        offset += 1
        open_ = open_[~unequal & (offset < length[open_])]
    return differs


def common_prefixes(s: np.ndarray, sa: np.ndarray, breaks: np.ndarray, most: int) -> np.ndarray:
    """Length shared by each suffix and the one before it in the order, by position, exact below ``most``.

    A suffix whose predecessor continues its left neighbour's match shares one character less than that
    neighbour; only the others, and those after ``breaks``, are compared, six characters below 1024 at a time.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    compare = np.ones(n, bool)
    compare[1:] = (before[1:] < 1) | (s[:-1] != s[np.maximum(before[1:] - 1, 0)]) | breaks[:-1]
    at = np.flatnonzero(compare & (before >= 0))
    longer = np.concatenate((s, np.zeros(most + 16, s.dtype))).astype(np.uint64)
    word = longer[: n + most + 8].copy()
    shift = np.uint64(10)
    for k in range(1, 6):
        word |= longer[k : n + most + 8 + k] << (shift * np.uint64(k))
    shared = np.zeros(n, np.int64)
    open_ = at
    while len(open_):
        i, j = open_ + shared[open_], before[open_] + shared[open_]
        same = word[np.minimum(i, n)] == word[np.minimum(j, n)]
        same &= (np.maximum(i, j) + 6 <= n) & (shared[open_] < most)
        shared[open_[same]] += 6
        open_ = open_[same]
    open_ = at
    for _ in range(6):
        i, j = open_ + shared[open_], before[open_] + shared[open_]
        same = (np.maximum(i, j) < n) & (shared[open_] < most)
        same &= s[np.minimum(i, n - 1)] == s[np.minimum(j, n - 1)]
        open_ = open_[same]
        shared[open_] += 1
    last = np.maximum.accumulate(np.where(compare, np.arange(n), -1))
    return np.maximum(0, shared[last] - (np.arange(n) - last))
