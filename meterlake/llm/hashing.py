"""Vectorised rolling hashes of byte ranges and words, modulo 2**64."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**64, (2, 256), dtype=np.uint64)
_BASE = [0x9E3779B97F4A7C15 | 1, 0xD1B54A32D192ED03 | 1]
_powers: list[tuple[np.ndarray, np.ndarray]] = [(np.ones(1, np.uint64), np.ones(1, np.uint64))] * 2


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """(base**i, base**-i) for i < n at least; the base is odd and so has an inverse."""
    if len(_powers[which][0]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        base = _BASE[which]
        both = []
        for b in (base, pow(base, -1, 2**64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _powers[which] = (both[0], both[1])
    return _powers[which]


class RangeHash:
    """Hashes of ranges of one byte array; equal bytes hash alike wherever they stand."""

    def __init__(self, data: np.ndarray, which: int = 0):
        self.which = which
        up, _ = powers(len(data) + 1, which)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[which][data] * up[: len(data)], out=self.prefix[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, down = powers(len(self.prefix), self.which)
        return mix((self.prefix[end] - self.prefix[start]) * down[start] + (end - start).astype(np.uint64))


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, none of which crosses a row offset."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside])
    after = np.concatenate([inside, [False]])
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return starts, ends


#: Bytes hashed at a time; a word longer than LONG_WORD is hashed as a chain of parts of that length.
PIECE = 1 << 19
LONG_WORD = 1 << 16
_CHAIN = np.uint64(0xD1B54A32D192ED03)


def _long_word(data: np.ndarray, start: int, end: int) -> np.uint64:
    h = np.array([end - start], np.uint64)
    for at in range(start, end, LONG_WORD):
        part = data[at : min(at + LONG_WORD, end)]
        h = mix(h * _CHAIN + RangeHash(part)(np.zeros(1, np.int64), np.array([len(part)])))
    return h[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, shown: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all rows in turn, row bounds into them).

    Words are runs of bytes for which is_word[shown[byte]] holds, compared as shown[byte]. What is held
    besides data and the result is bounded by `piece`, however long a row or a word is.
    """
    hashes, starts, at, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0, len(data)
    while at < n:
        end = min(at + piece, n)
        rows = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, end, "right")]
        if end < n and is_word[shown[data[end]]] and (not len(rows) or rows[-1] < end):
            # The piece ends after its last gap or row; where it has none, one word fills it and more.
            gaps = np.flatnonzero(~is_word[shown[data[at:end]]])
            cut = max(at + int(gaps[-1]) + 1 if len(gaps) else at, int(rows[-1]) if len(rows) else at)
            if cut == at:
                limit = int(offsets[np.searchsorted(offsets, at, "right")])
                cut = end
                while cut < limit:
                    gaps = np.flatnonzero(~is_word[shown[data[cut : min(cut + piece, limit)]]])
                    cut = cut + int(gaps[0]) if len(gaps) else min(cut + piece, limit)
                    if len(gaps):
                        break
                hashes.append(np.array([_long_word(shown[data[at:cut]], 0, cut - at)], np.uint64))
                starts.append(np.array([at]))
                at = cut
                continue
            end = cut
        part = shown[data[at:end]]
        lo, hi = np.searchsorted(offsets, at, "right") - 1, np.searchsorted(offsets, end, "left") + 1
        begin, stop = spans(is_word[part], np.clip(offsets[lo:hi] - at, 0, len(part)))
        found = RangeHash(part)(begin, stop)
        for k in np.flatnonzero(stop - begin > LONG_WORD):
            found[k] = _long_word(part, int(begin[k]), int(stop[k]))
        hashes.append(found)
        starts.append(begin + at)
        at = end
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)
