"""Hashes of the words of many texts at once, over the bytes of an Arrow column.

A word is a run of ASCII letters and digits and of bytes above 127; A-Z and the capitals of Latin-1
are lower-cased. Its hash is a polynomial over its bytes modulo 2**64, taken from prefix sums, so that
the work is a few array operations a megabyte. Texts are taken in groups of CHUNK bytes; one that is
longer is cut between words, so memory is bounded by CHUNK and eight bytes a word of one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 2 * CHUNK)
            both = []
            for x in (_P, pow(_P, -1, 1 << 64)):
                steps = np.full(m, x, dtype=np.uint64)
                steps[0] = 1
                both.append(np.multiply.accumulate(steps))
            self.up, self.down = both
        return self.up[:n], self.down[:n]


_powers = _Powers()


def fold(data: np.ndarray) -> np.ndarray:
    low = _FOLD[data]
    capital = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1
    low[capital] += 32
    return low


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _words(data: np.ndarray, breaks: np.ndarray, stems: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, a row of hashes of their first bytes for each length in ``stems``, and where
    they start. No word crosses ``breaks``."""
    low = fold(data)
    inside = _IN_WORD[low]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = breaks[breaks < len(data)]
    first[at] = inside[at]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    at = at[at > 0] - 1
    last[at] = inside[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    at_start, back = sums[starts], down[starts]
    first_bytes = np.empty((len(stems), len(starts)), dtype=np.uint64)
    for i, stem in enumerate(stems):
        first_bytes[i] = mix((sums[np.minimum(ends, starts + stem)] - at_start) * back + np.uint64(stem))
    return mix((sums[ends] - at_start) * back), first_bytes, starts


def word_groups(
    column: pa.Array, stems: tuple[int, ...] = ()
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, words, first bytes, row of each word) for consecutive rows of a binary column.
    Null counts as empty."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1)
        to = min(to, len(column))
        own = offsets[row : to + 1] - offsets[row]
        if own[-1] <= CHUNK:
            part = data[offsets[row] : offsets[to]]
            words, begun, starts = _words(part, own, stems)
            yield row, to - row, words, begun, np.searchsorted(own, starts, side="right") - 1
        else:  # a single text
            found, begin, end = [], int(offsets[row]), int(offsets[to])
            while begin < end:
                stop = min(end, begin + CHUNK)
                if stop < end:
                    gaps = np.flatnonzero(~_IN_WORD[_FOLD[data[begin:stop]]])
                    stop = begin + int(gaps[-1]) + 1 if len(gaps) else stop
                found.append(_words(data[begin:stop], np.zeros(1, dtype=np.int64), stems)[:2])
                begin = stop
            words = np.concatenate([w for w, _ in found])
            begun = np.concatenate([b for _, b in found], axis=1)
            yield row, 1, words, begun, np.zeros(len(words), dtype=np.int64)
        row = to
