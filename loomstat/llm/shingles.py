"""Word hashes and shingle sets of whole texts, vectorised over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes whose hashes are worked out at a time; temporaries are about fifty times that.
PIECE = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_rng = np.random.Generator(np.random.PCG64(7))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)[LOWER]  # A-Z count as a-z
ODD = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, PIECE + 64), x, np.uint64))]) for x in (BASE, INVERSE)]
    return _powers


def _words(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of data; a word also ends at the offsets in breaks.

    A word's polynomial over its letters comes from prefix sums, shifted back by the inverse power of its start.
    """
    n = len(data)
    power, inverse = _power_tables(n + 1)
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    inner = breaks[(breaks > 0) & (breaks < n)]
    first[inner] = inside[inner]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(LETTER[data] * power[:n], out=prefix[1:])
    return starts, mix64((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def _long_words(data: np.ndarray) -> np.ndarray:
    """Word hashes of one long text, piece by piece, cut at white space (a word longer than a piece stays whole)."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and not SPACE[data[end]]:
            stop = np.flatnonzero(SPACE[data[end : end + PIECE]])
            end = end + int(stop[0]) if len(stop) else min(len(data), end + PIECE)
        out.append(_words(data[at:end], np.zeros(0, np.int64))[1])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def word_hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    """The word hashes of each text in turn, for a string array; null texts have none."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    valid = texts.is_valid().to_numpy(zero_copy_only=False)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
        if offsets[stop] - offsets[row] > PIECE:
            yield _long_words(data[offsets[row] : offsets[row + 1]]) if valid[row] else np.zeros(0, np.uint64)
            row += 1
            continue
        part, marks = data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        starts, hashes = _words(part, marks) if len(part) else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        cuts = np.searchsorted(starts, marks)
        for i in range(stop - row):
            yield hashes[cuts[i] : cuts[i + 1]] if valid[row + i] else hashes[:0]
        row = stop


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct k-word shingles; all words as one shingle where there are fewer; nothing without words."""
    n = len(words)
    if n == 0:
        return words
    if n < k:
        return mix64((words * ODD[:n]).sum(keepdims=True, dtype=np.uint64) + ODD[32 + n : 33 + n])
    total = words[: n - k + 1] * ODD[0]
    for j in range(1, k):
        total += words[j : n - k + 1 + j] * ODD[j]
    found = np.sort(mix64(total))
    first = np.ones(len(found), bool)
    np.not_equal(found[1:], found[:-1], out=first[1:])
    return found[first]
