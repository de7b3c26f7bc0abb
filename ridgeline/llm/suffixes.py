"""Suffix arrays by induced sorting over numpy arrays, and permuted common prefixes.

The order of suffixes is induced bucket by bucket, so each step moves a whole batch of suffixes and work stays linear in the text.
The leftmost-smaller suffixes are sorted by recursion on the string of their substrings' names. Where that string has too many
symbols for buckets, its suffixes are placed by sorting what they hold up to the next leftmost-smaller one, whose rank decides.
"""

from __future__ import annotations

import numpy as np

#: A reduced string is induced by buckets while its alphabet is under this fraction of its length.
SPARSE = 200


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes of an array of non-negative integers, in lexicographic order; a prefix sorts first."""
    n = len(text)
    if n < 2:
        return np.arange(n, dtype=np.int64)
    if text.dtype == np.uint8:
        number = np.cumsum(np.bincount(text, minlength=256) > 0)
        symbols = int(number[-1])
        t = number.astype(np.uint8 if symbols < 256 else np.uint16)[text]  # narrow, so that gathers stay in the cache
    else:
        kinds, t = np.unique(text, return_inverse=True)
        t, symbols = t.astype(np.int64) + 1, len(kinds)
    return _induced(np.append(t, t.dtype.type(0)), symbols + 1)[1:]  # 0 ends the text


def _induced(t: np.ndarray, sigma: int) -> np.ndarray:
    n = len(t)
    smaller = _types(t)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    heads = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=sigma))])
    order = _induce(t, smaller, lms, heads)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    by_substring = order[is_lms[order]]
    names, distinct = _named(t, lms, by_substring)
    if distinct == len(lms):
        return _induce(t, smaller, by_substring, heads)
    # Sort the leftmost-smaller suffixes as suffixes of the string of names.
    return _induce(t, smaller, lms[_reduced(names, distinct)], heads)


def _reduced(r: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix order of a string of names under sigma, by recursion on its own leftmost-smaller substrings."""
    n = len(r)
    if n < 2:
        return np.arange(n)
    t = np.concatenate([r + 1, [0]])
    if sigma * SPARSE < n:
        return _induced(t, sigma + 1)[1:]
    smaller = _types(t)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    kind = 2 * t + smaller
    names, distinct = _names(kind, lms)
    if distinct < len(lms):
        rank = np.empty(len(lms), np.int64)
        rank[_reduced(names, distinct)] = np.arange(len(lms))
    else:
        rank = names
    # Larger types by what they hold up to the next leftmost-smaller suffix, whose rank ends a tie; then smaller types up to the
    # next larger one. At equal symbols a larger type comes first, as its kind does.
    ends = kind * (n + 2)
    ends[lms] += rank + 1
    others = np.setdiff1d(np.flatnonzero(smaller), lms, assume_unique=True)
    ends[others] = ends.max() + 1 + np.arange(len(others))  # take no part yet
    larger = _doubled(ends[:-1])
    larger = larger[~smaller[larger]]
    ends = kind * (n + 2)
    ends[larger] += np.arange(len(larger))
    return _doubled(ends[:-1])


def _names(kind: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of the substrings from each leftmost-smaller position to the next, equal for equal ones, and their number. Only ties
    are compared further; no substring is the beginning of another."""
    length = np.diff(np.append(lms, len(kind) - 1)) + 1
    _, rank = np.unique(kind[lms], return_inverse=True)
    k = 1
    live = np.flatnonzero((np.bincount(rank)[rank] > 1) & (length > 1))
    rank = rank * (len(lms) + 1)  # room for the ranks within a tie
    top = int(kind.max()) + 1
    joint = (len(lms) + 1) ** 2 * top < 1 << 62
    while len(live):
        then = kind[lms[live] + k]
        by = np.argsort(rank[live] * top + then) if joint else np.lexsort((then, rank[live]))
        live, then = live[by], then[by]
        own = rank[live]
        first = np.concatenate([[True], own[1:] != own[:-1]])
        step = first | np.concatenate([[True], then[1:] != then[:-1]])
        start = np.flatnonzero(first)[np.cumsum(first) - 1]
        at = np.flatnonzero(step)[np.cumsum(step) - 1]
        rank[live] = own + (at - start)
        alone = step & np.append(step[1:], True)
        k += 1
        live = live[~alone & (length[live] > k)]
    kinds, rank = np.unique(rank, return_inverse=True)
    return rank, len(kinds)


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the last, empty one is."""
    n = len(t)
    change = np.flatnonzero(t[:-1] != t[1:])  # never empty: the end differs from all
    at = np.repeat(change, np.diff(change, prepend=-1))
    return np.concatenate([t[at] < t[at + 1], [True]])


def _place(out: np.ndarray, t: np.ndarray, items: np.ndarray, free: np.ndarray, step: int) -> None:
    """Puts items, in order, at the free ends of their buckets."""
    c = t[items]
    order = _by_symbol(c, len(free)).argsort(kind="stable")
    c = c[order]
    first = np.concatenate([_ZERO, np.flatnonzero(c[1:] != c[:-1]) + 1])
    size = np.empty_like(first)
    size[:-1] = first[1:] - first[:-1]
    size[-1] = len(c) - first[-1]
    kinds = c[first]
    out[np.repeat(free[kinds] - step * first, size) + np.arange(0, step * len(c), step)] = items[order]
    free[kinds] += step * size


_ZERO = np.zeros(1, np.int64)


def _by_symbol(c: np.ndarray, sigma: int) -> np.ndarray:
    """Symbols below sigma as numbers of 16 bits at most, if they fit, which are sorted by radix."""
    return c.astype(np.uint16) if sigma < 65536 and c.dtype.itemsize > 2 else c


def _induce(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The order of all suffixes from the leftmost-smaller ones in the order given: larger types rightwards, then smaller types leftwards."""
    n, sigma = len(t), len(heads) - 1
    own = t[lms]
    by_bucket = lms[np.argsort(_by_symbol(own, sigma), kind="stable")]
    cut = np.searchsorted(t[by_bucket], np.arange(sigma + 1))
    out = np.full(n, -1, np.int64)
    # What stands before position 0 is the last, empty suffix here, which neither mask takes.
    larger, smaller = ~smaller, smaller.copy()
    larger[-1] = smaller[-1] = False
    free = heads[:-1].copy()
    for c in range(sigma):
        at = heads[c]
        while at < free[c]:  # those of this bucket, and then those that they bring to it
            upto = free[c]
            before = out[at:upto] - 1
            before = before[larger[before]]
            at = upto
            if len(before):
                _place(out, t, before, free, 1)
        before = by_bucket[cut[c] : cut[c + 1]] - 1
        if len(before):
            _place(out, t, before, free, 1)
    ends = free.copy()  # each bucket's larger types end here
    free = heads[1:] - 1
    out[0] = n - 1
    for c in range(sigma - 1, -1, -1):
        at = heads[c + 1] - 1
        while at > free[c]:
            downto = free[c]
            before = out[downto + 1 : at + 1][::-1] - 1
            before = before[smaller[before]]
            at = downto
            if len(before):
                _place(out, t, before, free, -1)
        before = out[heads[c] : ends[c]][::-1] - 1
        if c == 0:
            before = np.array([n - 2], np.int64)
        before = before[smaller[before]]
        if len(before):
            _place(out, t, before, free, -1)
    return out


def _named(t: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the leftmost-smaller substrings in text order, equal for equal ones, and their number."""
    length = np.zeros(len(t), np.int64)
    length[lms] = np.diff(np.append(lms, len(t) - 1)) + 1
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    live = np.flatnonzero(same)
    k = 0
    while len(live):
        differ = t[a[live] + k] != t[b[live] + k]
        same[live[differ]] = False
        k += 1
        live = live[~differ & (length[a[live]] > k)]
    name = np.zeros(len(t), np.int64)
    name[ordered] = np.concatenate([[0], np.cumsum(~same)])
    return name[lms], int((~same).sum()) + 1


def _doubled(r: np.ndarray) -> np.ndarray:
    """Suffix order by doubling ranks; only suffixes that still tie are sorted again, in as many rounds as the logarithm of a tie."""
    n = len(r)
    order = np.argsort(r)
    s = r[order]
    first = np.concatenate([[True], s[1:] != s[:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.flatnonzero(first)[np.cumsum(first) - 1]
    rank[n] = -1
    k = 1
    tied = np.flatnonzero(~(first & np.append(first[1:], True)))  # places in the order
    while len(tied):
        items = order[tied]
        own, then = rank[items], rank[np.minimum(items + k, n)]
        key = np.argsort(own * (n + 2) + then + 1)
        items, own, then = items[key], own[key], then[key]
        order[tied] = items
        new_own = np.concatenate([[True], own[1:] != own[:-1]])
        first = new_own | np.concatenate([[True], then[1:] != then[:-1]])
        at = np.flatnonzero(first)[np.cumsum(first) - 1]
        group = np.flatnonzero(new_own)[np.cumsum(new_own) - 1]
        rank[items] = own + (at - group)
        tied = tied[~(first & np.append(first[1:], True))]
        k *= 2
    return order


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each position, the length that its suffix shares with the one before it in suffix order; 0 for the first.

    Where the symbols before both are equal, the value is the previous position's less one; only the others are compared."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    phi = np.full(n, -1, np.int64)
    phi[order[1:]] = order[:-1]
    i = np.arange(n)
    reducible = (i > 0) & (phi > 0)
    reducible[reducible] = text[i[reducible] - 1] == text[phi[reducible] - 1]
    start = np.flatnonzero(~reducible)
    value = np.zeros(len(start), np.int64)
    live = np.flatnonzero(phi[start] >= 0)
    a, b = start[live], phi[start[live]]
    if text.dtype == np.uint8:  # eight symbols at once, first symbol in the lowest byte
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        words = np.ndarray((n,), "<u8", padded, strides=(1,))
        while len(live):
            apart = words[a] ^ words[b]
            same = apart == 0
            ends = ~same
            lowest = apart[ends] & (~apart[ends] + np.uint64(1))
            value[live[ends]] += np.log2(lowest.astype(np.float64)).astype(np.int64) >> 3
            live, a, b = live[same], a[same] + 8, b[same] + 8
            value[live] += 8
            inside = np.maximum(a, b) < n
            live, a, b = live[inside], a[inside], b[inside]
        value = np.minimum(value, n - np.maximum(start, phi[start]))
    else:
        _finish(text, a, b, value, live)
    at = np.zeros(n, np.int64)
    at[start] = np.arange(len(start))
    at = np.maximum.accumulate(at)
    return np.maximum(value[at] + start[at] - i, 0)


def _finish(text: np.ndarray, a: np.ndarray, b: np.ndarray, value: np.ndarray, live: np.ndarray) -> None:
    n = len(text)
    while len(live):
        x, y = a + value[live], b + value[live]
        ok = np.maximum(x, y) < n
        ok[ok] = text[x[ok]] == text[y[ok]]
        a, b, live = a[ok], b[ok], live[ok]
        value[live] += 1
