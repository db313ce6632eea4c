"""Suffix arrays by induced sorting, and permuted common prefixes, in NumPy.

Leftmost-smaller substrings are sorted and named, and the string of names is
sorted by the same procedure until all names differ; then suffixes are induced.
Induction runs a bucket at a time while buckets are full: what a bucket's
entries induce is one array operation, and so is each round of a run of equal
symbols. Strings of names have so many symbols that their buckets are nearly
empty; they are induced entry by entry, which is the same order. Both are linear.
"""

from __future__ import annotations

import numpy as np

#: Entries that a bucket must have on average for induction by buckets to pay.
FULL = 64


def _types(s: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one; the last, the sentinel, is."""
    step = np.empty(len(s), dtype=np.int8)
    step[:-1] = np.sign(s[1:].astype(np.int64) - s[:-1])
    step[-1] = 1
    place = np.where(step != 0, np.arange(len(s)), len(s) - 1)
    return step[np.minimum.accumulate(place[::-1])[::-1]] > 0


def _deal(symbols: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Places of entries that go, in order, to the next free place of their symbols; moves ``free`` on."""
    if len(free) <= 1 << 16:
        symbols = symbols.astype(np.uint16)  # sorted by radix
    order = np.argsort(symbols, kind="stable")
    sorted_ = symbols[order].astype(np.int64)
    first = np.flatnonzero(np.diff(sorted_, prepend=-1))
    counts = np.diff(first, append=len(sorted_))
    place = np.empty(len(symbols), dtype=np.int64)
    place[order] = np.arange(len(sorted_)) - np.repeat(first, counts) + free[sorted_]
    free[sorted_[first]] += counts
    return place


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """The suffixes in order, given the leftmost-smaller ones in order."""
    n = len(s)
    n_large = np.bincount(s[~small], minlength=size)
    n_small = np.bincount(s[small], minlength=size)
    start = np.concatenate([[0], np.cumsum(n_large + n_small)])
    out = np.full(n, -1, dtype=np.int64)
    out[0] = n - 1
    # Larger suffixes, from the front.
    seeds = lms[np.argsort(s[lms], kind="stable")]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(s[lms], minlength=size))])
    free = start[:-1].copy()
    present = np.flatnonzero(n_large + n_small)
    for c in present.tolist():
        at = start[c]
        while at < free[c]:
            block = out[at : free[c]]
            at = free[c]
            before = block[block > 0] - 1
            before = before[~small[before]]
            if len(before):
                out[_deal(s[before], free)] = before
        block = seeds[bounds[c] : bounds[c + 1]]
        before = block[block > 0] - 1
        if len(before):
            out[_deal(s[before], free)] = before
    # Smaller suffixes, from the back: places count down from the ends of buckets.
    taken = np.zeros(size, dtype=np.int64)
    last = start[1:] - 1
    for c in present[::-1].tolist():
        at = 0
        while at < taken[c]:
            block = out[last[c] - taken[c] + 1 : last[c] - at + 1][::-1]
            at = taken[c]
            before = block[block > 0] - 1
            before = before[small[before]]
            if len(before):
                own = s[before]
                out[last[own] - _deal(own, taken)] = before
        block = out[start[c] : start[c] + n_large[c]][::-1]
        before = block[block > 0] - 1
        before = before[small[before]]
        if len(before):
            own = s[before]
            out[last[own] - _deal(own, taken)] = before
    return out


def _names(s: np.ndarray, small: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of the leftmost-smaller substrings, in text order, where equal ones share a rank, and how many there are.

    A symbol and its type together are one code; with these no substring starts
    another. Codes are compared some at a time, each time only of substrings
    that are still equal to others and not at their end.
    """
    code = s.astype(np.int64) * 2 + small + 1
    bits = int(code.max()).bit_length()
    step = max(1, 62 // bits)
    length = np.append(np.diff(lms) + 1, 1)
    rank = np.zeros(len(lms), dtype=np.int64)
    live, done = np.arange(len(lms)), 0
    while len(live):
        key = np.zeros(len(live), dtype=np.int64)
        for k in range(done, done + step):
            at = np.minimum(lms[live] + k, len(s) - 1)
            key = key << bits | np.where(k < length[live], code[at], 0)
        # Ranks leave room for those of equal ones: a rank is the number of smaller substrings.
        order = np.lexsort((key, rank[live])) if done else np.argsort(key, kind="stable")
        own, key = rank[live][order], key[order]
        fresh = np.append(True, (own[1:] != own[:-1]) | (key[1:] != key[:-1]))
        first = np.flatnonzero(fresh)
        group = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        within = np.repeat(first, np.diff(first, append=len(own))) - np.repeat(group, np.diff(group, append=len(own)))
        rank[live[order]] = own + within
        size = np.repeat(np.diff(first, append=len(own)), np.diff(first, append=len(own)))
        done += step
        live = live[order][size > 1]
        live = live[length[live] > done]
    used = np.zeros(len(lms), dtype=np.int64)
    used[rank] = 1
    names = np.cumsum(used) - 1
    return names[rank], int(names[-1]) + 1


def _induce_each(s: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """What :func:`_induce` gives, an entry at a time."""
    counts = np.bincount(s, minlength=size)
    ends = np.cumsum(counts)
    heads, tails = (ends - counts).tolist(), ends.tolist()
    # By suffix, the symbol before it if that starts a larger (smaller) suffix; -1 also for no suffix, the last place.
    before = np.append(-1, s[:-1].astype(np.int64))
    is_small = np.append(False, small[:-1])
    large_before, small_before = (np.append(np.where(x, before, -1), -1).tolist() for x in (~is_small, is_small))
    seeds = lms[np.argsort(s[lms], kind="stable")]
    out = np.full(len(s), -1, dtype=np.int64)
    # The leftmost-smaller suffixes, in order, at the ends of their buckets.
    own, first = np.unique(s[seeds], return_index=True)
    many = np.diff(first, append=len(seeds))
    out[np.repeat(ends[own] - many - first, many) + np.arange(len(seeds))] = seeds
    order = out.tolist()
    for i in order:
        c = large_before[i]
        if c >= 0:
            at = heads[c]
            order[at], heads[c] = i - 1, at + 1
    for i in reversed(order):
        c = small_before[i]
        if c >= 0:
            tails[c] = at = tails[c] - 1
            order[at] = i - 1
    # The last suffix, the sentinel's, is induced by none.
    order[0] = len(s) - 1
    return np.array(order, dtype=np.int64)


def suffix_array(s: np.ndarray, size: int) -> np.ndarray:
    """Starts of the suffixes of ``s`` in order; symbols are below ``size``, the last is the only 0."""
    if len(s) <= 2:
        return np.arange(len(s))[::-1].copy()
    small = _types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    names, many = _names(s, small, lms)
    if many < len(lms):
        order = lms[suffix_array(names, many)]
    else:
        order = np.empty(len(lms), dtype=np.int64)
        order[names] = lms
    return (_induce if size * FULL <= len(s) else _induce_each)(s, small, order, size)


def common_prefixes(s: np.ndarray, order: np.ndarray, starts: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Permuted common prefixes and the suffix before each suffix in order (-1 for the first).

    ``room[i]`` is how far from i a match may reach (to the end of its piece);
    ``starts`` are the starts of pieces. Only irreducible values are compared;
    the others follow, as each is one less than its left neighbour's.
    """
    n = len(s)
    phi = np.full(n, -1, dtype=np.int64)
    phi[order[1:]] = order[:-1]
    left = np.where(phi > 0, s[phi - 1], -1)
    own = np.empty(n, dtype=left.dtype)
    own[0], own[1:] = -2, s[:-1]
    fresh = (left != own) | (phi <= 0)
    fresh[starts] = True
    # Six symbols of at most ten bits at a time.
    word = np.zeros(n + 8, dtype=np.uint64)
    wide = np.zeros(n + 16, dtype=np.uint64)
    wide[:n] = s
    for k in range(6):
        word[: n + 8] |= wide[k : n + 8 + k] << np.uint64(10 * k)
    at = np.flatnonzero(fresh & (phi >= 0))
    plcp = np.zeros(n, dtype=np.int64)
    live, k = at, 0
    while len(live):
        live = live[room[live] > k]
        i, j = live + k, phi[live] + k
        inside = j < n
        live, i, j = live[inside], i[inside], j[inside]
        xor = word[i] ^ word[j]
        same = xor == 0
        rest, x = live[~same], xor[~same]
        step = np.zeros(len(rest), dtype=np.int64)
        for q in range(1, 6):
            step += (x & np.uint64((1 << (10 * q)) - 1)) == 0
        plcp[rest] = k + step
        k += 6
        live = live[same]
        plcp[live] = k
    last = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    plcp = np.where(fresh, plcp, plcp[last] - (np.arange(n) - last))
    return np.minimum(np.maximum(plcp, 0), room), phi
