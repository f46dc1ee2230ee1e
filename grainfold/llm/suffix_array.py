"""Suffix arrays by induced sorting, in numpy.

Suffixes are classified as smaller (S) or larger (L) than their right neighbour; leftmost smaller ones (LMS)
begin the substrings that are sorted and named; if names repeat, the string of names is sorted recursively.
From the sorted LMS suffixes the L suffixes are induced from left to right and then the S suffixes from right
to left. Over bytes this is done bucket by bucket: whatever stands in a bucket is scanned as one batch, its
predecessors are appended to their buckets, and a batch that appends to its own bucket makes the next one,
so that each suffix is moved once. Over names (many buckets) a suffix is placed by the symbols up to the
suffix that induces it and that one's rank, which is the same order.
"""

from __future__ import annotations

import numpy as np


def classify(s: np.ndarray) -> np.ndarray:
    """True for S suffixes. s ends with a unique smallest symbol."""
    step = np.diff(s.astype(np.int64))
    where = np.where(step != 0, np.arange(len(step)), len(step) - 1)
    where = np.minimum.accumulate(where[::-1])[::-1]
    return np.append(step[where] > 0, True)


def refine(rank: np.ndarray, items: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Split the groups of equal rank that items (whole groups) make up, by keys; returns the items still not alone.

    A group's rank is the place of its first member in the final order, so that only its own members change.
    """
    if not len(items):
        return items
    by_key = np.argsort(keys)
    items, keys = items[by_key], keys[by_key]
    if rank[items].any():
        order = np.argsort(rank[items], kind="stable")
        items, keys = items[order], keys[order]
    group = rank[items]
    new_group = np.concatenate(([True], group[1:] != group[:-1]))
    new = new_group | np.concatenate(([True], keys[1:] != keys[:-1]))
    place = np.arange(len(items))
    first, first_of_group = np.maximum.accumulate(np.where(new, place, 0)), np.maximum.accumulate(np.where(new_group, place, 0))
    rank[items] = group + first - first_of_group
    alone = new & np.append(new[1:], True)
    return items[~alone]


def ranks(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int, last: np.ndarray | None = None) -> np.ndarray:
    """Ranks of symbols[start : end + 1] by symbol, then of `last`; no such string is a prefix of another, but for equal ones."""
    each = 63 // bits
    rank, at, active = np.zeros(len(starts), np.int64), starts.copy(), np.arange(len(starts))
    ended = []
    while len(active):
        low, high = at[active], ends[active]
        key = np.zeros(len(active), np.int64)
        for k in range(each):
            place = low + k
            key = (key << bits) | np.where(place <= high, symbols[np.minimum(place, len(symbols) - 1)], 0)
        active = refine(rank, active, key)
        at[active] += each
        more = at[active] <= ends[active]
        ended.append(active[~more])
        active = active[more]
    if last is not None:
        tied = np.concatenate([*ended, np.zeros(0, np.int64)])
        refine(rank, tied, last[tied])
    return rank


def induce_buckets(s: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array of s (symbols below 512) from its sorted LMS suffixes."""
    top = int(s.max()) + 1
    sizes, larges = np.bincount(s, minlength=top), np.bincount(s[~small], minlength=top)
    ends = np.cumsum(sizes)
    out = np.empty(len(s), np.int64)
    symbols = s.astype(np.uint16)

    def deal(batch: np.ndarray, at: int, want_small: bool, into: list[list[np.ndarray]]) -> np.ndarray:
        """Append the predecessors of a batch to their buckets; those of the own bucket are returned."""
        before = batch[batch > 0] - 1
        before = before[small[before] == want_small]
        found = symbols[before]
        mine = before[found == at]
        other = found != at
        before, found = before[other], found[other]
        if len(before):
            order = np.argsort(found, kind="stable")
            before, found = before[order], found[order]
            cut = np.flatnonzero(found[1:] != found[:-1]) + 1
            for part, c in zip(np.split(before, cut), found[np.concatenate(([0], cut))].tolist(), strict=True):
                into[c].append(part)
        return mine

    first = symbols[lms]
    own = np.split(lms, np.searchsorted(first, np.arange(1, top)))
    queue: list[list[np.ndarray]] = [[] for _ in range(top)]
    for c in range(top):
        done, batch = [], np.concatenate(queue[c]) if queue[c] else lms[:0]
        while len(batch):
            done.append(batch)
            batch = deal(batch, c, False, queue)
        if done:
            out[ends[c] - sizes[c] : ends[c] - sizes[c] + larges[c]] = np.concatenate(done)
        if len(own[c]):
            deal(own[c], c, False, queue)
    queue = [[] for _ in range(top)]
    for c in range(top - 1, -1, -1):  # from right to left: batches are kept reversed
        done, batch = [], np.concatenate(queue[c]) if queue[c] else lms[:0]
        while len(batch):
            done.append(batch)
            batch = deal(batch, c, True, queue)
        low = ends[c] - sizes[c] + larges[c]
        if c == 0:
            done = [np.array([len(s) - 1])]  # the last symbol
        if done:
            out[low : ends[c]] = np.concatenate(done)[::-1]
        if larges[c]:
            deal(out[ends[c] - sizes[c] : low][::-1], c, True, queue)
        if c == 0:
            break
    return out


def induce_ranks(s: np.ndarray, small: np.ndarray, lms: np.ndarray, bits: int) -> np.ndarray:
    """The same for any number of symbols."""
    n, symbols = len(s), (s.astype(np.int64) << 1) | small
    place = np.arange(n)
    rank = np.zeros(n, np.int64)
    rank[lms] = np.arange(len(lms))
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    following = np.minimum.accumulate(np.where(is_lms, place, n - 1)[::-1])[::-1]
    large = np.flatnonzero(~small)
    rank[large] = ranks(symbols, large, following[large], bits, rank[following[large]])
    following = np.minimum.accumulate(np.where(~small, place, n)[::-1])[::-1]
    some = np.flatnonzero(small[:-1])
    # an S suffix whose run reaches the last symbol does not exist: the last but one is L
    rank[some] = ranks(symbols, some, following[some], bits, rank[following[some]])
    rank[n - 1] = -1
    return np.lexsort((rank, small, s))


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Of symbols >= 1 with a single 0 at the end."""
    n = len(s)
    if n < 3:
        return np.arange(n)[::-1].copy()
    small = classify(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    bits = int(2 * int(s.max()) + 1).bit_length()
    if len(lms) > 1:
        symbols = (s.astype(np.int64) << 1) | small
        ends = np.append(lms[1:], n - 1)
        names = ranks(symbols, lms, ends, bits)
        repeated = np.bincount(names).max() > 1
        lms = lms[suffix_array(names) if repeated else np.argsort(names)]  # the last one is the 0 alone, and only its name is 0
    return induce_buckets(s, small, lms) if s.max() < 512 else induce_ranks(s, small, lms, bits)


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """By text position: the common prefix with the suffix before it in the array.

    Only irreducible positions (whose left neighbours differ) are compared, eight bytes at a time; at any
    other the value is that of the position before, less one.
    """
    n = len(t)
    phi = np.empty(n, np.int64)
    phi[sa[0]] = -1
    phi[sa[1:]] = sa[:-1]
    left = np.arange(n) - 1
    other = phi - 1
    irreducible = (phi < 0) | (left < 0) | (other < 0)
    irreducible |= t[np.maximum(left, 0)] != t[np.maximum(other, 0)]
    a = np.flatnonzero(irreducible)
    b = phi[a]
    padded = np.concatenate([t.astype(np.uint8), np.zeros(8, np.uint8)])
    words = np.ndarray((n + 1,), "<u8", padded.tobytes(), strides=(1,))
    value = np.zeros(len(a), np.int64)
    active = np.flatnonzero(b >= 0)
    while len(active):
        x, y = a[active] + value[active], b[active] + value[active]
        inside = np.maximum(x, y) < n
        active, x, y = active[inside], x[inside], y[inside]
        diff = words[x] ^ words[y]
        same = np.full(len(active), 8)
        off = diff != 0
        lowest = diff[off] & (~diff[off] + np.uint64(1))
        same[off] = np.log2(lowest.astype(np.float64)).astype(np.int64) >> 3
        value[active] += np.minimum(same, n - np.maximum(x, y))
        active = active[~off]
    owner = np.cumsum(irreducible) - 1
    return np.maximum(value[owner] - (np.arange(n) - a[owner]), 0)
