"""Cutting whole batches of texts into pieces that byte-level BPE treats separately.

The public pattern splits text into runs of letters, of digits, of other marks (each with
at most one space before it) and of white space.  The cuts made here are all boundaries of
that pattern, found for a whole Arrow batch at once from the classes of neighbouring bytes:

* before white space that follows something else;
* after a single white-space character other than a space;
* where letters, digits and other marks meet.

No cut is made beside an apostrophe (contractions) or inside a text with characters outside
ASCII and Latin letters: such a piece is longer and is left to the encoder.  Pieces repeat
often, so each distinct one of a batch is encoded once, and a bounded store keeps the ids
of short pieces from batch to batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE, _BLANK, _LETTER, _DIGIT, _MARK, _QUOTE, _OTHER = range(7)

_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[[9, 10, 11, 12, 13]] = _BLANK
_CLASS[32] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[39] = _QUOTE
_CLASS[0x80:0xC0] = _LETTER  # continuation bytes of the letters below
_CLASS[0xC3:0xCA] = _LETTER  # U+00C0 to U+024F
_CLASS[0xC0:0xC3] = _CLASS[0xCA:] = _OTHER

_CUT = np.zeros(64, np.uint8)
for _a in range(7):
    for _b in range(7):
        if _a > _BLANK and _b <= _BLANK:
            _CUT[_a * 8 + _b] = 1
        elif _a == _BLANK and _b > _BLANK:
            _CUT[_a * 8 + _b] = 2  # if the blank stands alone
        elif _a != _b and {_a, _b} <= {_LETTER, _DIGIT, _MARK}:
            _CUT[_a * 8 + _b] = 1


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a binary or string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64) - offsets[0]


def cut(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pieces."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    c = np.frombuffer(data.tobytes().translate(_CLASS.tobytes()), np.uint8)
    kind = _CUT[(c[:-1] << 3) | c[1:]]
    at = np.flatnonzero(kind) + 1
    alone = kind[at - 1] == 2
    alone &= c[np.maximum(at - 2, 0)] <= _BLANK
    at = at[~(alone & (at >= 2))]
    odd = np.flatnonzero(c == _OTHER)
    signs = np.flatnonzero((data == 0x97) | (data == 0xB7))  # U+00D7 and U+00F7 are no letters
    odd = np.concatenate([odd, signs[(signs > 0) & (data[signs - 1] == 0xC3)]])
    if len(odd):
        whole = np.zeros(len(offsets), bool)
        whole[np.searchsorted(offsets, odd, "right") - 1] = True
        at = at[~whole[np.searchsorted(offsets, at, "right") - 1]]
    here = np.zeros(n, bool)
    here[at] = True
    here[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(here)


def simple(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which of the pieces that lie end to end are one match of the pattern for sure: one class, a space before it at most."""
    c = _CLASS[data]
    blank, odd = c <= _BLANK, c >= _QUOTE
    odd |= (c == _BLANK) & ~np.isin(np.arange(len(data)), places[:-1][np.diff(places) == 1])
    odd |= (data == 0x97) | (data == 0xB7)  # may end U+00D7 or U+00F7, which are no letters
    blanks, odds = (np.concatenate([[0], np.cumsum(x)])[places] for x in (blank, odd))
    return (np.diff(odds) == 0) & (np.diff(blanks) <= 1)


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[s:s+n] for each start and length, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


class PieceStore:
    """Ids of distinct pieces; ``encode(list of bytes)`` gives (flat ids, each piece's start in them, its number of ids).

    ``most`` bounds the entries that are kept and ``longest`` a kept piece's bytes.
    """

    def __init__(self, encode, most: int = 600_000, longest: int = 64):
        self.encode, self.most, self.longest = encode, most, longest
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.flat, self.used, self.count = np.zeros(1 << 16, np.uint32), 0, 0
        self.starts, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _add(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> int:
        """Append the ids of new pieces; their first number."""
        total, first, n = len(flat), self.count, len(lengths)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + n > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.flat[self.used : self.used + total] = flat
        self.starts[first : first + n] = self.used + starts
        self.lengths[first : first + n] = lengths
        self.used, self.count = self.used + total, first + n
        return first

    def of(self, column: pa.Array, slice_bytes: int = 4 << 20) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of the batch, ids per text), a few MB of text at a time."""
        data, offsets = texts_of(column)
        ids, sizes, begin, n = [], [], 0, len(offsets) - 1
        while begin < n:
            stop = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + slice_bytes, "right")) - 1)
            some, per = self._of(data[offsets[begin] : offsets[stop]], offsets[begin : stop + 1] - offsets[begin])
            ids.append(some)
            sizes.append(per)
            begin = stop
        return np.concatenate(ids or [np.zeros(0, np.uint32)]), np.concatenate(sizes or [np.zeros(0, np.int64)])

    def _of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = cut(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        places = np.append(starts, len(data)).astype(np.int32)
        coded = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        held, bounds = texts_of(coded.dictionary)
        held, bounds = held.tobytes(), bounds.tolist()
        flat, begin, length = self.lookup([held[a:b] for a, b in zip(bounds, bounds[1:], strict=False)])
        index = np.asarray(coded.indices)
        piece_lengths = length[index]
        ends = np.concatenate([[0], np.cumsum(piece_lengths)])
        return ragged(flat, begin[index], piece_lengths), np.diff(ends[np.searchsorted(starts, offsets)])

    def lookup(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, start, length) of each of the distinct pieces."""
        if len(self.place) > self.most:
            self.clear()
        get = self.place.get
        at = np.array([get(p, -1) for p in pieces], np.int64)
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            new = [pieces[i] for i in fresh.tolist()]
            first = self._add(*self.encode(new))
            at[fresh] = first + np.arange(len(new))
            if max(map(len, new)) <= self.longest:
                self.place.update(zip(new, range(first, first + len(new)), strict=True))
            else:
                self.place.update((p, n) for n, p in enumerate(new, first) if len(p) <= self.longest)
        out = self.flat, self.starts[at], self.lengths[at]
        if self.used > 8 * self.most:  # long pieces have filled the store
            self.clear()
        return out
