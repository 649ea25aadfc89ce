"""Owners of fixed-length byte windows, by winnowing.

Every run of ``GRAM`` bytes has a 64-bit hash.  A window of ``SPAN`` bytes is owned by the
gram in it with the smallest hash (the rightmost of equals), so equal windows have equal
owners at equal places.  Consecutive windows mostly share an owner; such a run of windows
and the bytes it covers (a stretch) is described by one row.
"""

from __future__ import annotations

import numpy as np

SPAN = 200
GRAM = 64
_PLACE = 20  # low bits of the order key: the place in a slice of at most 2**20 bytes

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 64, 256, np.uint64, endpoint=False)
_STEP = _rng.integers(0, 1 << 64, 8, np.uint64, endpoint=False) | np.uint64(1)
_BASE = np.uint64(0xD1B54A32D192ED03)
_MIX = np.uint64(0x9E3779B97F4A7C15)


_LOW = 10  # a power is the product of two, of a place's low bits and of the others: no worker holds a table of all places


def _tables(base: int) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.full(1 << _LOW, base, np.uint64), np.full((1 << (_PLACE - _LOW)) + 1, pow(base, 1 << _LOW, 1 << 64), np.uint64)
    low[0] = high[0] = 1
    return np.cumprod(low, dtype=np.uint64), np.cumprod(high, dtype=np.uint64)


_UP, _DOWN = _tables(int(_BASE)), _tables(pow(int(_BASE), -1, 1 << 64))


def _first_powers(size: int, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    low, high = tables
    return (high[: (size >> _LOW) + 1, None] * low).ravel()[:size]


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, size + 1 of each."""
    if size <= 1 << _PLACE:
        return _first_powers(size + 1, _UP), _first_powers(size + 1, _DOWN)
    return _powers(size + 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _BASE
    return x ^ (x >> np.uint64(32))


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes (a power of two) from each place on, from the bytes' random values."""
    held, width, k = x, 1, 0
    while width < GRAM:
        held = held[:-width] * _STEP[k] + held[width:]
        width, k = width * 2, k + 1
    return mixed(held)


def stretches(data: np.ndarray, offsets: np.ndarray):
    """(text, first window, windows, owner's hash, hash of the bytes and the owner's place in them) of each stretch.

    The texts together hold at most 2**20 bytes, or are one text, which is read in slices.
    """
    limit = (1 << _PLACE) - 1
    if len(data) > limit:
        parts, begin = [], 0
        while begin + SPAN <= len(data):  # one long text: slices overlap by a window less a byte
            stop = min(len(data), begin + limit)
            text, first, *rest = stretches(data[begin:stop], np.array([0, stop - begin]))
            parts.append((text, first + begin, *rest))
            begin = stop - SPAN + 1
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else stretches(data[:0], offsets[:1])
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    if len(data) < SPAN:
        return none
    x = _BYTE[data]
    grams = gram_hashes(x)
    order = (grams >> np.uint64(_PLACE) << np.uint64(_PLACE)) | (np.uint64(limit) - np.arange(len(grams), dtype=np.uint64))
    reach = SPAN - GRAM + 1
    low, width = order, 1
    while width * 2 <= reach:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (reach - width)], low[reach - width :])
    valid = np.zeros(len(low), bool)  # windows inside one text
    sizes = np.diff(offsets)
    some = sizes >= SPAN
    edge = np.zeros(len(low) + 1, np.int32)
    np.add.at(edge, offsets[:-1][some], 1)
    np.add.at(edge, offsets[1:][some] - SPAN + 1, -1)
    valid = np.cumsum(edge[:-1]) > 0
    change = np.empty(len(low), bool)
    change[0] = True
    np.not_equal(low[1:], low[:-1], out=change[1:])
    change[1:] |= valid[1:] != valid[:-1]
    change[offsets[:-1][some]] = True
    first = np.flatnonzero(change)
    count = np.diff(np.append(first, len(low)))
    first, count = first[valid[first]], count[valid[first]]
    if not len(first):
        return none
    place = limit - (low[first] & np.uint64(limit)).astype(np.int64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * _first_powers(len(x), _UP), dtype=np.uint64)])
    content = (sums[first + count - 1 + SPAN] - sums[first]) * _DOWN[0][first & ((1 << _LOW) - 1)] * _DOWN[1][first >> _LOW]
    content = mixed(content + mixed((place - first).astype(np.uint64) * _STEP[1] + count.astype(np.uint64) * _STEP[2]))
    text = np.searchsorted(offsets, first, "right") - 1
    return text, first - offsets[text], count, grams[place], content


def slices(offsets: np.ndarray, most: int = (1 << 17)):
    """Ranges of texts that together hold few bytes."""
    begin, n = 0, len(offsets) - 1
    while begin < n:
        stop = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1)
        yield begin, stop
        begin = stop
