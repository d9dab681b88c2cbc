"""Words of whole Arrow batches as 64-bit hashes, and hashes of their windows, all in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer document is taken in parts that end at white space.
PIECE = 1 << 20
_M = (1 << 64) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (fixed constants): each bit of the result depends on each bit of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE, SECOND_BASE = 0xD6E8FEB86659FD93, 0xE7037ED1A0B428DB
#: What a byte counts as, and the base of its place's power: two hashes of a word that don't depend on each other.
_VALUES = [mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(k)) for k in (0x9E3779B97F4A7C15, 0xA0761D6478BD642F)]
_BASES = (_BASE, SECOND_BASE)
#: Of a word that is longer, the powers of its places begin anew, each time with another factor.
_LONGEST = 4096
_POWERS = [np.multiply.accumulate(np.array([1] + [b] * (_LONGEST - 1), np.uint64)) for b in _BASES]


def _weights(offset: np.ndarray, kind: int) -> np.ndarray:
    """The weight of each place of a word."""
    if not len(offset) or offset.max() < _LONGEST:
        return _POWERS[kind][offset]
    high = (offset // _LONGEST).astype(np.uint64)
    return _POWERS[kind][offset % _LONGEST] * np.where(high, mix(high), np.uint64(1))  # short words hash alike beside long ones


def _hash(buf: np.ndarray, starts: np.ndarray, lower: bool, kind: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of buf, and where it begins; starts: bytes at which documents begin."""
    inside = ~_SPACE[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = starts[starts < len(buf)]
    first[cut] |= inside[cut]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    begin = np.flatnonzero(first[at])
    lengths = np.diff(np.append(begin, len(at)))
    offset = np.arange(len(at)) - np.repeat(begin, lengths)
    data = _LOWER[buf[at]] if lower else buf[at]
    sums = np.add.reduceat(_VALUES[kind][data] * _weights(offset, kind), begin)
    return mix(sums + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), at[begin]


def _hash_long(buf: np.ndarray, lower: bool, kind: int = 0) -> np.ndarray:
    """Hashes of one long document, part by part."""
    out, a = [], 0
    while a < len(buf):
        b = min(len(buf), a + PIECE)
        while b < len(buf) and not (spaces := np.flatnonzero(_SPACE[buf[b : b + 4096]])).size:
            b = min(len(buf), b + 4096)
        b = b + int(spaces[0]) if b < len(buf) else b
        out.append(_hash(buf[a:b], np.zeros(1, np.int64), lower, kind)[0])
        a = b
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def pieces(texts: pa.Array, lower: bool = False, kind: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes, edges) for groups of rows: row first + k has the words hashes[edges[k] : edges[k + 1]]. Nulls have none.

    kind: 0 or 1, which of two independent hashes."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and offsets[-1] else np.empty(0, np.uint8)
    k = 0
    while k < n:
        end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + PIECE, "right")) - 1)
        buf = data[offsets[k] : offsets[end]]
        if end == k + 1 and len(buf) > PIECE:
            hashes = _hash_long(buf, lower, kind)
            edges = np.array([0, len(hashes)])
        else:
            begins = (offsets[k:end] - offsets[k]).astype(np.int64)
            hashes, at = _hash(buf, begins, lower, kind)
            edges = np.append(np.searchsorted(at, begins, "left"), len(hashes))
        yield k, end, hashes, edges
        k = end


def rolling(h: np.ndarray, size: int, base: int = _BASE) -> np.ndarray:
    """Hash of each run of size values (not mixed): result[i] is of h[i : i + size]. Built by doubling."""
    if len(h) < size:
        return np.empty(0, np.uint64)
    total, width, done, power = None, 1, 0, h
    rest = size
    while rest:
        if rest & 1:  # append a run of this width to what is there
            if total is None:
                total, done = power, width
            else:
                n = min(len(total), len(power) - done)
                total = total[:n] * np.uint64(pow(base, width, 1 << 64)) + power[done : done + n]
                done += width
        rest >>= 1
        if rest:
            power = power[:-width] * np.uint64(pow(base, width, 1 << 64)) + power[width:]
            width *= 2
    return total[: len(h) - size + 1]


def whole(edges: np.ndarray, size: int, n: int) -> np.ndarray:
    """Of n window starts, which windows of size words stay in one document."""
    ok = np.ones(n, bool)
    for e in edges[1:-1]:  # a window that starts up to size - 1 words before a document's end reaches into the next
        ok[max(0, e - size + 1) : e] = False
    return ok
