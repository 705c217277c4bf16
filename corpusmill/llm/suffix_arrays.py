"""Suffix arrays by induced sorting, and their permuted common prefixes, in whole-array steps."""

from __future__ import annotations

import numpy as np


def _suffix_types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S-type); the last counts as such."""
    n = len(s)
    differs = np.flatnonzero(s[:-1] != s[1:])
    at = np.full(n, n - 1)
    at[differs] = differs
    at = np.minimum.accumulate(at[::-1])[::-1]  # the end of the run of equal symbols that each place lies in
    out = np.ones(n, dtype=bool)
    inside = at < n - 1
    out[inside] = s[at[inside]] < s[at[inside] + 1]
    return out


def _append(sa: np.ndarray, ends: np.ndarray, symbols: np.ndarray, items: np.ndarray, step: int) -> None:
    """Put ``items`` in order behind (or, with ``step`` -1, before) what stands in their symbols' buckets."""
    order = np.argsort(symbols, kind="stable")
    symbols, items = symbols[order], items[order]
    first = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
    size = np.diff(np.r_[first, len(symbols)])
    rank = np.arange(len(symbols)) - np.repeat(first, size)
    sa[ends[symbols] + step * rank] = items
    ends[symbols[first]] += step * size


def _induce(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Suffix array from the leftmost S-type places ``lms`` in order; linear, one bucket after another."""
    n = len(s)
    sa = np.full(n, -1)
    stop = np.cumsum(counts)
    start = stop - counts
    tail = stop - 1
    _append(sa, tail, s[lms][::-1], lms[::-1], -1)
    used = np.flatnonzero(counts)
    # Larger (L-type) suffixes, from the smallest bucket up: each takes its place from the suffix behind it.
    head, lms_from = start.copy(), tail + 1
    for c in used.tolist():
        at = start[c]
        while at < head[c]:  # what is put into this very bucket is read in the next round
            some, at = sa[at:head[c]] - 1, head[c]
            some = some[some >= 0]
            some = some[~is_s[some]]
            if len(some):
                _append(sa, head, s[some], some, 1)
        some = sa[lms_from[c]:stop[c]] - 1
        some = some[some >= 0]
        some = some[~is_s[some]]
        if len(some):
            _append(sa, head, s[some], some, 1)
    # Smaller (S-type) suffixes, from the largest bucket down; the leftmost ones are put anew.
    tail = stop - 1
    for c in used[::-1].tolist():
        at = stop[c] - 1
        while at > tail[c]:
            some, at = sa[tail[c] + 1:at + 1][::-1] - 1, tail[c]
            some = some[some >= 0]
            some = some[is_s[some]]
            if len(some):
                _append(sa, tail, s[some], some, -1)
        some = sa[start[c]:head[c]][::-1] - 1
        some = some[some >= 0]
        some = some[is_s[some]]
        if len(some):
            _append(sa, tail, s[some], some, -1)
    return sa


def _rank_by_doubling(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of ``names`` by their first ``depth`` names."""
    rank, k, n = names.astype(np.int64), 1, len(names)
    while True:
        follow = np.zeros(n, dtype=np.int64)
        follow[:n - k] = rank[k:] + 1
        key = rank * (n + 2) + follow
        order = np.argsort(key, kind="stable")
        new = np.r_[0, np.cumsum(np.diff(key[order]) != 0)]
        k *= 2
        if new[-1] == n - 1 or k >= min(depth, n):
            return order
        rank[order] = new


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``s`` ordered by their first ``depth`` symbols at least.

    ``s``: unsigned symbols that end in a 0 which stands nowhere else.  Suffixes that agree in ``depth`` symbols are
    neighbours in any order.  Leftmost S-type substrings are sorted by inducing and named; the string of names is
    ranked; inducing from this order gives all suffixes.
    """
    n = len(s)
    if n < 2:
        return np.arange(n)
    is_s = _suffix_types(s)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    counts = np.bincount(s, minlength=int(s.max()) + 1)
    sa = _induce(s, is_s, lms, counts)
    if len(lms) < 2:
        return sa
    # Name the substrings from one leftmost place to the next, equal ones alike.
    number = np.full(n, -1)
    number[lms] = np.arange(len(lms))
    order = number[sa[number[sa] >= 0]]
    length = np.r_[np.diff(lms) + 1, 1]
    same = length[order[1:]] == length[order[:-1]]
    a, b, left = lms[order[1:]], lms[order[:-1]], length[order[1:]]
    todo, d = np.flatnonzero(same), 0
    while len(todo):
        todo = todo[left[todo] > d]
        equal = s[a[todo] + d] == s[b[todo] + d]
        same[todo[~equal]] = False
        todo, d = todo[equal], d + 1
    names = np.empty(len(lms), dtype=np.int64)
    names[order] = np.r_[0, np.cumsum(~same)]
    if names.max() < len(lms) - 1:
        order = _rank_by_doubling(names, depth)  # each name spans at least one symbol more
    return _induce(s, is_s, lms[order], counts)


def common_prefixes(s: np.ndarray, sa: np.ndarray, starts: np.ndarray, limit: int) -> np.ndarray:
    """Permuted common prefixes: for each place, the symbols it shares with its forerunner in ``sa``.

    A place whose symbol before agrees with its forerunner's has one less than the place before it; only the others
    (and the ``starts`` of pieces) are compared, up to ``limit`` symbols, which must be no less than any piece's length.
    """
    n = len(s)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    own = np.ones(n, dtype=bool)
    i = np.flatnonzero((before > 0) & (np.arange(n) > 0))
    own[i] = s[i - 1] != s[before[i] - 1]
    own[starts] = True
    own[before < 0] = True
    w = np.zeros(n + limit + 4, dtype=np.uint64)
    for j in range(4):
        w[:max(n - j, 0)] |= s[j:].astype(np.uint64) << np.uint64(16 * j)
    plcp = np.zeros(n, dtype=np.int64)
    todo, done = np.flatnonzero(own & (before >= 0)), 0
    while len(todo) and done < limit:
        x = w[todo + done] ^ w[before[todo] + done]
        part = (x & np.uint64(0xFFFF) == 0).astype(np.int64)
        part += (x & np.uint64(0xFFFFFFFF) == 0).astype(np.int64)
        part += (x & np.uint64(0xFFFFFFFFFFFF) == 0).astype(np.int64)
        plcp[todo] += part + (x == 0)
        todo, done = todo[x == 0], done + 4
    at = np.maximum.accumulate(np.where(own, np.arange(n), 0))
    return np.maximum(plcp[at] - (np.arange(n) - at), 0)
