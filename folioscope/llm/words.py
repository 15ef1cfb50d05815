"""Words of whole texts as 64-bit hashes, found in numpy over the bytes of a batch.

A word of at most ``SHORT`` bytes is hashed eight bytes at a time, each eight mixed into what the
ones before gave, so that no sum or power of letters can cancel; a longer one by BLAKE2b. Where a
result rests on two words being equal, ``same_spelling`` compares the words themselves.

Every text is handled in pieces of at most ``PIECE`` bytes that end between words; only a single
word longer than that makes a longer piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

PIECE = 1 << 20
SHORT = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that belong to words: all but ASCII white space; ASCII letters and digits, and all beyond ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))


def _masked(lane: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Of each lane the first ``left`` bytes."""
    return np.where(left < 8, lane & ((np.uint64(1) << (np.minimum(left, 7) * 8).astype(np.uint64)) - np.uint64(1)), lane)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each span of bytes."""
    n = ends - starts
    out = mix(n.astype(np.uint64) * _ODD + np.uint64(1))
    lanes = _lanes(data)
    some = np.flatnonzero(n <= SHORT)
    for k in range(0, SHORT, 8):
        some = some[n[some] > k]
        if not len(some):
            break
        out[some] = mix((out[some] ^ _masked(lanes[starts[some] + k], n[some] - k)) + _ODD)
    for i in np.flatnonzero(n > SHORT).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def same_spelling(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> bool:
    """Whether each span has the same bytes as the span whose number ``other`` gives for it."""
    n = ends - starts
    if (n != n[other]).any():
        return False
    lanes = _lanes(data)
    some, k = np.flatnonzero((n <= SHORT) & (other != np.arange(len(other)))), 0
    while len(some):
        left = n[some] - k
        if (_masked(lanes[starts[some] + k], left) != _masked(lanes[starts[other[some]] + k], left)).any():
            return False
        k += 8
        some = some[n[some] > k]
    long = np.flatnonzero((n > SHORT) & (other != np.arange(len(other)))).tolist()
    return all(np.array_equal(data[starts[i] : ends[i]], data[starts[other[i]] : ends[other[i]]]) for i in long)


def pieces(offsets: np.ndarray, data: np.ndarray, member: np.ndarray, size: int | None = None) -> Iterator[tuple[int, int, int, int]]:
    """Runs of rows (first row, one past the last, first byte, one past the last), of ``size`` bytes (``PIECE``) at most.

    A longer row comes in several, each of which ends between words; ``member`` says which bytes
    belong to words, once A-Z are a-z.
    """
    row, n, size = 0, len(offsets) - 1, size or PIECE
    while row < n:
        if offsets[row + 1] - offsets[row] > size:
            at, stop = int(offsets[row]), int(offsets[row + 1])
            while stop - at > size:
                cut = at + size
                back = np.flatnonzero(~member[LOWER[data[at:cut]]])
                if len(back):
                    cut = at + int(back[-1]) + 1
                else:
                    while cut < stop:  # a word that is longer than a piece
                        gap = np.flatnonzero(~member[LOWER[data[cut : min(cut + size, stop)]]])
                        if len(gap):
                            cut += int(gap[0])
                            break
                        cut = min(cut + size, stop)
                yield row, row + 1, at, cut
                at = cut
            if at < stop:
                yield row, row + 1, at, stop
            row += 1
            continue
        end = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        end = max(end, row + 1)
        yield row, end, int(offsets[row]), int(offsets[end])
        row = end


#: The byte that stands for each byte in a word's shape: one letter for all of its kind.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[65:91], SHAPE[97:123], SHAPE[0x80:], SHAPE[48:58] = 65, 97, 97, 48


def _folded(raw: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the capital letters from U+00C0 to U+00DE as small ones."""
    out = LOWER[raw]
    second = np.flatnonzero(raw[:-1] == 0xC3) + 1
    second = second[(raw[second] >= 0x80) & (raw[second] <= 0x9E) & (raw[second] != 0x97)]
    out[second] += 0x20
    return out


def _shape(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kinds of each word's bytes, runs of one kind as one: bytes, starts, ends."""
    kind = SHAPE[raw]
    keep = np.ones(len(raw), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[starts] = True
    place = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    return kind[keep], place[starts], place[ends]


def word_hashes(data: np.ndarray, offsets: np.ndarray, member: np.ndarray, spelling: str = "lower") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of whole rows: (first row, one past the last, word hashes, offset of each row's words).

    ``member`` says which bytes belong to words, once A-Z are a-z. A row longer than a piece comes
    alone. Spellings: lower (A-Z as a-z), folded (Latin-1 capitals too), shape (kinds of
    characters, runs as one).
    """
    kept: list[np.ndarray] = []
    for first, last, start, stop in pieces(offsets, data, member):
        raw = LOWER[data[start:stop]]
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = member[raw]
        if last > first + 1:
            # rows that touch must not share a word: break at each row's start
            step = np.diff(inside)
            edges = (offsets[first + 1 : last] - start).astype(np.int64)
            touch = edges[(edges > 0) & (edges < len(raw))]
            touch = touch[(inside[touch] == 1) & (inside[touch + 1] == 1)]
            starts = np.flatnonzero(step == 1)
            ends = np.flatnonzero(step == -1)
            if len(touch):
                starts = np.sort(np.concatenate([starts, np.unique(touch)]))
                ends = np.sort(np.concatenate([ends, np.unique(touch)]))
        else:
            step = np.diff(inside)
            starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        if spelling == "shape":
            kind, begins, stops = _shape(data[start:stop], starts, ends)
            hashes = span_hashes(kind, begins, stops)
        else:
            hashes = span_hashes(_folded(data[start:stop]) if spelling == "folded" else raw, starts, ends)
        if last == first + 1 and offsets[first + 1] - offsets[first] > PIECE:
            kept.append(hashes)
            if stop < offsets[first + 1]:
                continue
            hashes, kept = np.concatenate(kept), []
            yield first, last, hashes, np.array([0, len(hashes)])
            continue
        at = np.searchsorted(starts, offsets[first : last + 1] - start)
        at[-1] = len(starts)
        yield first, last, hashes, at


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k consecutive words (across rows too; the caller leaves those out)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, k, np.uint64)
    for j in range(k):
        total = mix((total ^ hashes[j : j + n]) + _ODD)
    return total
