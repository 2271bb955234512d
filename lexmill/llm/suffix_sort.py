"""Suffix arrays by induced sorting, and permuted common prefixes.

A text is an integer array. Suffixes are S (smaller than the next suffix) or L;
a leftmost S is an S after an L. Substrings between leftmost S positions are
sorted by one round of inducing, named, and their order is settled by the same
method on the string of names; one more round of inducing then gives all
suffixes. A round handles each bucket as a few array operations. The recursion
ends where the names are too many for that; their string is
ranked by doubling.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is of type S; the last is S."""
    n = len(t)
    s = np.ones(n, bool)
    if n > 1:
        differs = np.flatnonzero(t[:-1] != t[1:])
        nearest = np.searchsorted(differs, np.arange(n - 1))
        known = nearest < len(differs)
        at = differs[nearest[known]]
        s[:-1][known] = t[at] < t[at + 1]
    return s


def _split(batch: np.ndarray, chars: np.ndarray, queues: list) -> None:
    """Append each position to its character's queue, in order."""
    n = len(batch)
    if n > 1:
        order = chars.argsort(kind="stable")
        chars, batch = chars[order], batch[order]
        cuts = [0, *((chars[1:] != chars[:-1]).nonzero()[0] + 1).tolist(), n]
        for c, a, b in zip(chars[cuts[:-1]].tolist(), cuts, cuts[1:]):  # noqa: B905
            queues[c].append(batch[a:b])
    elif n:
        queues[int(chars[0])].append(batch)


def _scan(t: np.ndarray, kind: np.ndarray, chars: range, placed: list, given: list) -> None:
    """One direction of inducing: ``placed`` gets, by character, the positions of the kind that ``kind`` marks.

    In each bucket the induced positions come before those in ``given``.
    """
    for c in chars:
        waiting, done = placed[c], []
        batch = np.concatenate(waiting) if waiting else np.zeros(0, np.int32)
        while len(batch):
            done.append(batch)
            before = batch[batch > 0] - 1
            before = before[kind[before]]
            ch = t[before]
            same = ch == c
            _split(before[~same], ch[~same], placed)
            batch = before[same]
        placed[c] = done
        rest = given[c]
        if len(rest):
            before = rest[rest > 0] - 1
            before = before[kind[before]]
            _split(before, t[before], placed)


def _induce(t: np.ndarray, s: np.ndarray, k: int, seeds: np.ndarray) -> np.ndarray:
    """All suffixes in order, from leftmost-S positions in order."""
    empty = np.zeros(0, np.int32)
    lms: list = [empty] * k
    held: list = [[] for _ in range(k)]
    _split(seeds, t[seeds], held)
    for c, parts in enumerate(held):
        if parts:
            lms[c] = np.concatenate(parts)
    large: list = [[] for _ in range(k)]
    _scan(t, ~s, range(k), large, lms)
    ls = [np.concatenate(x) if x else empty for x in large]
    small: list = [[] for _ in range(k)]
    last = np.array([len(t) - 1], np.int32)
    small[int(t[-1])].append(last)
    _scan(t, s, range(k - 1, -1, -1), small, [x[::-1] for x in ls])
    ss = [np.concatenate(x)[::-1] if x else empty for x in small]
    return np.concatenate([p for c in range(k) for p in (ls[c], ss[c])])


def _doubled(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names: ranks of 1, 2, 4, ... names from each position until all differ."""
    n, reach = len(names), 1
    rank = names.astype(np.int64)
    while True:
        after = np.zeros(n, np.int64)
        after[: n - reach] = rank[reach:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        new = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
        if int(new[-1]) == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        reach *= 2


def _same_substrings(t: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether t[a : a + size] equals t[b : b + size], pair by pair."""
    out = np.zeros(len(a), bool)
    live = np.arange(len(a))
    step = 0
    while len(live):
        done = size[live] == step
        out[live[done]] = True
        live = live[~done]
        live = live[t[a[live] + step] == t[b[live] + step]]
        step += 1
    return out


def suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """Starts of all suffixes of ``t`` (values 0 to k - 1, the last one less than all others) in ascending order."""
    t = np.asarray(t, np.int32)
    n = len(t)
    if n <= 2:
        return np.arange(n)[::-1].copy()
    s = _types(t)
    lms = (np.flatnonzero(s[1:] & ~s[:-1]) + 1).astype(np.int32)
    # buckets of so many names hold too few entries for array operations: the end of the recursion
    if k > 1024:
        return _doubled(t)
    induce = lambda seeds: _induce(t, s, k, seeds)
    order = induce(lms[np.argsort(t[lms], kind="stable")])
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = order[is_lms[order]]
    # length of each substring up to and with the next leftmost S
    size = np.ones(n, np.int32)
    size[lms[:-1]] = np.diff(lms) + 1
    a, b = order[:-1], order[1:]
    same = size[a] == size[b]
    same[same] = _same_substrings(t, a[same], b[same], size[a[same]])
    names = np.zeros(n, np.int32)
    names[order] = np.concatenate([[0], np.cumsum(~same)])
    reduced = names[lms]
    if int(names[order[-1]]) + 1 == len(lms):
        ranked = order
    else:
        ranked = lms[suffix_array(reduced, int(reduced.max()) + 1)]
    return induce(ranked)


def permuted_prefixes(data: np.ndarray, sa: np.ndarray, most: int, stride: int = 8) -> np.ndarray:
    """For each position, the common prefix with the suffix before it in ``sa``, up to ``most`` bytes.

    From one position to the next it falls by one at most. So every
    ``stride``-th is compared, and between two of them only where the bounds
    that they give leave a choice.
    """
    n = len(sa)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    cap = most + stride
    padded = np.concatenate([data, np.zeros(cap + 16, np.uint8)])
    word = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(padded) - 7,), (1,))
    out = np.zeros(n, np.int64)

    def compare(at: np.ndarray, done: np.ndarray) -> None:
        at, done = at[phi[at] >= 0], done[phi[at] >= 0]
        room = np.minimum(cap, n - np.maximum(at, phi[at]))
        while len(at):
            x = word[at + done] ^ word[phi[at] + done]
            low = x & (~x + np.uint64(1))
            same = np.where(x == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) >> 3)
            done = done + same
            on = (x == 0) & (done < room)
            out[at[~on]] = np.minimum(done[~on], room[~on])
            at, done, room = at[on], done[on], room[on]

    grid = np.arange(0, n, stride)
    compare(grid, np.zeros(len(grid), np.int64))
    rest = np.setdiff1d(np.arange(n), grid, assume_unique=True)
    before = rest // stride * stride
    low = np.maximum(out[before] - (rest - before), 0)
    after = np.minimum(before + stride, grid[-1])
    high = np.where(before + stride < n, out[after] + (after - rest), cap)
    # a bound that was cut off at ``cap`` is no bound from above
    known = (low >= most) | (low == high) & (before + stride < n) & (out[after] < cap)
    out[rest[known]] = low[known]
    compare(rest[~known], low[~known])
    return np.minimum(out, most)
