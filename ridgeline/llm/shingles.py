"""Word shingles of whole texts as sorted 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Bytes of text whose words are hashed at once, and bytes of a word beyond which it is hashed by itself.
PIECE, LONG = 1 << 18, 64

_STEP, _BLOCK = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: By number of bytes, the bits of a block that a word fills.
_FILLED = np.array([(1 << 8 * i) - 1 for i in range(8)] + [2**64 - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """For each text, its distinct shingles of `size` words, A-Z lower-cased, ascending; a text with fewer words is one shingle,
    and one without words has none. Words are what split() of bytes gives: runs of all but space and \\t\\n\\v\\f\\r."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > PIECE:
            yield from _sets(texts[at:i], size)
            at, total = i, 0
        total += len(t) + 1
    if at < len(texts):
        yield from _sets(texts[at:], size)


def _sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """shingle_sets() of texts that are worked together."""
    raw = np.frombuffer(b" ".join([*texts, b" " * 8]), np.uint8)  # a space ends each text; blocks may reach beyond the last
    begin, words = _hashed(raw)
    ends = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(begin, ends)  # words before each text's end
    count = np.diff(upto, prepend=0)
    n = np.maximum(len(words) - size + 1, 0)
    h = np.full(n, np.uint64(size))
    for i in range(size):
        h = mix(h * _STEP + words[i : i + n])
    out = []
    for k, last in zip(count.tolist(), upto.tolist()):
        if k >= size:
            own = h[last - k : last - size + 1]
            own.sort()
        else:
            own = _whole(words[last - k : last])
        out.append(own)
    flat = np.concatenate(out)
    kept = np.ones(len(flat), bool)
    np.not_equal(flat[1:], flat[:-1], out=kept[1:])
    cuts = np.concatenate([[0], np.cumsum([len(x) for x in out])])
    kept[cuts[:-1][cuts[:-1] < len(flat)]] = True
    upto = np.concatenate([[0], np.cumsum(kept)])[cuts].tolist()
    flat = flat[kept]
    return [flat[a:b] for a, b in zip(upto, upto[1:])]


def _whole(words: np.ndarray) -> np.ndarray:
    """The one shingle of a text of few words, or none."""
    h = np.full(min(len(words), 1), np.uint64(len(words)))
    for w in words:
        h = mix(h * _STEP + w)
    return h


def _hashed(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin in raw, which ends with eight spaces, and their hashes: blocks of eight bytes, each mixed with what comes
    before, so that no two words are equal for their pattern's sake."""
    inside = np.concatenate([[False], ~_SPACE[raw]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, length = edges[::2], edges[1::2] - edges[::2]
    blocks = np.ndarray((len(raw) - 7,), "<u8", np.ascontiguousarray(_LOWER[raw]), strides=(1,))
    h = mix(length.astype(np.uint64) * _STEP)
    live, at, left = slice(None), begin, np.minimum(length, LONG)
    while True:
        h[live] = mix((h[live] ^ (blocks[at] & _FILLED[np.minimum(left, 8)])) * _BLOCK)
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        live, at, left = more if isinstance(live, slice) else live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(length > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(_LOWER[raw[begin[i] : begin[i] + length[i]]].tobytes(), 9)
    return begin, h


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
