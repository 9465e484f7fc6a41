"""Words of many texts at once: runs of bytes of one kind, as Arrow strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .shingles import LOWER

#: Bytes of text that are cut at a time; temporaries are about thirty times that.
PIECE = 1 << 20
#: Kinds of bytes: part of a word, between words, between words that no phrase spans.
INSIDE, BETWEEN, BREAK = 0, 1, 2


def kinds(between: bytes, breaks: bytes = b"") -> np.ndarray:
    """A table of kinds: the bytes given, all others inside words."""
    table = np.zeros(256, np.uint8)
    table[list(between)] = BETWEEN
    table[list(breaks)] = BREAK
    return table


class Words:
    """The words of some rows in turn: code (number in distinct), row, and piece, which changes at each break and row."""

    def __init__(self, data: np.ndarray, marks: np.ndarray, kind: np.ndarray):
        """data: bytes of the rows, which end at marks[1:]; marks[0] is 0."""
        kind = kind[data]
        inside = kind == INSIDE
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        inner = marks[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        first[inner] = inside[inner]
        last[inner - 1] = inside[inner - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row = np.searchsorted(marks, starts, "right") - 1
        self.piece = np.cumsum(kind == BREAK, dtype=np.int32)[starts].astype(np.int64) + self.row if len(starts) else np.zeros(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(LOWER[data[inside]])).dictionary_encode()
        self.code = coded.indices.to_numpy().astype(np.int64)
        self.distinct = coded.dictionary


def _cuts(data: np.ndarray, kind: np.ndarray, at: int) -> Iterator[tuple[int, int]]:
    """Parts of one long text, cut after a break (after any byte between words where there are no breaks)."""
    ending = kind == (BREAK if (kind == BREAK).any() else BETWEEN)
    lo = 0
    while lo < len(data):
        hi = min(len(data), lo + PIECE)
        while hi < len(data):
            found = np.flatnonzero(ending[data[hi - 1 : hi - 1 + PIECE]])
            if len(found):
                hi += int(found[0])
                break
            hi = min(len(data), hi + PIECE)
        yield at + lo, at + hi
        lo = hi


def words_of(texts: pa.Array, kind: np.ndarray) -> Iterator[tuple[Words, int]]:
    """Words of the texts, A-Z as a-z, in parts of about PIECE bytes, each with the number of its first row. Null texts have none.

    A text longer than PIECE comes in parts of its own, none of which ends within a word or, where kind has breaks, within a piece.
    """
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    if texts.null_count:  # a null may lie over bytes of its own
        lengths = np.where(texts.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
        data = np.concatenate([np.zeros(0, np.uint8), *(data[o : o + m] for o, m in zip(offsets[:-1], lengths, strict=True) if m)])
        offsets = np.concatenate([[0], np.cumsum(lengths)])
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
        if offsets[stop] - offsets[row] > PIECE:
            for lo, hi in _cuts(data[offsets[row] : offsets[stop]], kind, int(offsets[row])):
                yield Words(data[lo:hi], np.array([0, hi - lo]), kind), row
        elif offsets[stop] > offsets[row]:
            yield Words(data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row], kind), row
        row = stop
