"""Byte-level BPE over the words of many texts: every merge is replayed once over all distinct words.

Texts gather in a chunk, as numbers of its distinct words. An inverted index leads from a pair's rank to the positions of words where
it stands; the ranks are taken in ascending order, a merge goes to all its positions at once and only looks at the neighbours
that it touches. The numbers are then read as ids, and decoding puts the bytes of the ids together again. A chunk is as
much as a task can hold, so nothing is shuffled: rows of all chunks' words would come to more than the texts.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, tidy

#: A chunk ends with the text that brings it over so many characters or distinct words.
CHUNK_CHARS, CHUNK_WORDS = 16 << 20, 1 << 19
#: Characters of a long text that are matched at a time.
LONG = 1 << 20

_ranks: dict[str, dict[bytes, int]] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    """Bytes and ranks of a rank file, read once a process."""
    if path not in _ranks:
        with open(path, "rb") as f:
            _ranks[path] = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return _ranks[path]


def default_ranks() -> tuple[str, str]:
    """Path and pattern of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: the leftmost pair of least rank is merged until no pair has a rank."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], sys.maxsize), i) for i in range(len(parts) - 1))
        if rank == sys.maxsize:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Merges:
    """The ranks of bytes and of pairs of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.spelled = {r: t for t, r in ranks.items()}
        pairs = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        pairs = np.array([*sorted(pairs), (np.iinfo(np.int64).max, -1)], np.int64)
        self.pairs, self.merged = pairs[:, 0].copy(), pairs[:, 1].copy()
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of a and b together, -1 where they have none."""
        pair = a << 32 | b
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.merged[at], -1)


class _Index:
    """Positions of pairs by rank, the least rank first."""

    def __init__(self):
        self.at: dict[int, list[np.ndarray]] = {}
        self.waiting: list[int] = []

    def note(self, places: np.ndarray, ranks: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo < hi:
                rank = int(ranks[lo])
                if rank not in self.at:
                    self.at[rank] = []
                    heapq.heappush(self.waiting, rank)
                self.at[rank].append(places[lo:hi])

    def least(self) -> tuple[int, np.ndarray]:
        rank = heapq.heappop(self.waiting)
        places = self.at.pop(rank)
        return rank, places[0] if len(places) == 1 else np.unique(np.concatenate(places))


def replay(words: list[bytes], merges: Merges) -> list[np.ndarray]:
    """The ids of distinct words, all merges applied in order of rank over all words.

    A word that is itself in the vocabulary is its own id. Where a merge makes a pair of lower rank than its own, the order of
    ranks would no longer be the word's own order; such a word is merged by itself.
    """
    whole = [merges.ranks.get(w, -1) for w in words]
    out = [np.array([r], np.int64) for r in whole]
    todo = [i for i, r in enumerate(whole) if r < 0 and words[i]]
    if not todo:
        return out
    size = np.array([len(words[i]) for i in todo])
    marks = np.concatenate([[0], np.cumsum(size + 1)])  # a place that is no byte before, between and after the words
    n = int(marks[-1]) + 1
    ids, inside = np.full(n, -1, np.int64), np.ones(n, bool)
    inside[marks] = False
    ids[inside] = merges.single[np.frombuffer(b"".join([words[i] for i in todo]), np.uint8)]
    word = np.repeat(np.arange(len(todo) + 1), np.concatenate([[1], size + 1])) - 1
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    index, odd, chosen = _Index(), set(), np.zeros(n, bool)
    places = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    ranks = merges.of(ids[places], ids[places + 1])
    index.note(places[ranks >= 0], ranks[ranks >= 0])
    while index.waiting:
        rank, p = index.least()
        a, q = ids[p], after[p]
        b = ids[q]
        there = (a >= 0) & (b >= 0)  # else another merge has taken one of the two
        there[there] = merges.of(a[there], b[there]) == rank
        p, q = p[there], q[there]
        if not len(p):
            continue
        chosen[p] = True
        overlap = chosen[q].any()
        chosen[p] = False
        if overlap:  # one letter again and again: pairs from the left
            keep, taken = np.ones(len(p), bool), -1
            for i, (x, y) in enumerate(zip(p.tolist(), q.tolist(), strict=True)):
                keep[i] = x != taken
                taken = taken if x == taken else y
            p, q = p[keep], q[keep]
        right = after[q]
        chosen[p] = True
        near = chosen[right]  # another pair of this rank follows: its first id may go with what has just been merged
        chosen[p] = False
        if near.any():
            new = merges.of(np.full(near.sum(), rank), ids[right[near]])
            odd.update(word[p[near][(new >= 0) & (new < rank)]].tolist())
        ids[p], ids[q], after[p], before[right] = rank, -2, right, p
        left = before[p]
        touched = np.concatenate([left[ids[left] >= 0], p[ids[right] >= 0]])
        new = merges.of(ids[touched], ids[after[touched]])
        touched, new = touched[new >= 0], new[new >= 0]
        odd.update(word[touched[new < rank]].tolist())
        index.note(touched, new)
    live = ids >= 0
    ends = np.cumsum(np.bincount(word[live], minlength=len(todo)))
    for k, (i, own) in enumerate(zip(todo, np.split(ids[live], ends[:-1]), strict=True)):
        out[i] = np.array(merge_word(words[i], merges.ranks), np.int64) if k in odd else own
    return out


def _matches(text: str, pattern: regex.Pattern) -> Iterator[list[str]]:
    """The matches of the pattern in a text, some at a time: a long text's last match of a part may go on in the next."""
    at = 0
    while len(text) - at > LONG:
        end = at + LONG
        while True:
            found = pattern.findall(text, at, end)
            # what the pattern makes of the last matches may depend on what follows
            if len(found) > 3 or end == len(text):
                break
            end = min(len(text), 2 * end - at)
        if end == len(text):
            break
        found = found[:-3]
        yield found
        at += sum(map(len, found))
    yield pattern.findall(text, at)


_merges: dict[str, Merges] = {}


def load_merges(path: str) -> Merges:
    """The merges of a rank file, worked out once a process."""
    if path not in _merges:
        _merges[path] = Merges(load_ranks(path))
    return _merges[path]


def decode(ids: np.ndarray, merges: Merges) -> bytes:
    """The bytes of ids."""
    return b"".join([merges.spelled[i] for i in ids.tolist()])


class _Chunk:
    """Words numbered in order of first appearance, and documents as numbers."""

    def __init__(self):
        self.words, self.docs, self.chars = {}, [], 0

    def add(self, doc_id: int | None, text: str, pattern: regex.Pattern) -> None:
        words, numbers = self.words, array("I")
        for found in _matches(text, pattern):
            for w in found:
                if w not in words:
                    words[w] = len(words)
            numbers.extend(map(words.__getitem__, found))
        self.docs.append((doc_id, numbers))
        self.chars += len(text)

    def rows(self, merges: Merges, with_ids: bool) -> Iterator[list[tuple]]:
        """The documents' rows, some at a time."""
        ids = replay([w.encode() for w in self.words], merges)
        said = [" ".join(map(str, x.tolist())).encode() for x in ids]
        back = [decode(x, merges) for x in ids]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        for lo in range(0, len(self.docs), 256):
            out = []
            for doc_id, numbers in self.docs[lo : lo + 256]:
                numbers = numbers.tolist()
                digests = [hashlib.sha256(sep.join([of[i] for i in numbers])).hexdigest() for sep, of in ((b" ", said), (b"", back))]
                own = [np.concatenate([ids[i] for i in numbers]).tolist() if numbers else []] if with_ids else []
                out.append((doc_id, int(count[numbers].sum()) if numbers else 0, *digests, *own))
            yield out


_FIELDS = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.list_(pa.int32()))]
_DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>"


def _encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to the rows of encode()."""
    compiled, merges, chunk = regex.compile(pattern), load_merges(path), _Chunk()
    schema = pa.schema(_FIELDS if with_ids else _FIELDS[:-1])

    def flush(chunk: _Chunk) -> Iterator[pa.RecordBatch]:
        for rows in chunk.rows(merges, with_ids):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            chunk.add(doc_id, text.as_py() or "", compiled)
            if chunk.chars >= CHUNK_CHARS or len(chunk.words) >= CHUNK_WORDS:
                yield from flush(chunk)
                chunk = _Chunk()
    yield from flush(chunk)


def encode(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", ranks: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids of every row of docs.

    Each match of pattern is encoded by itself by the ranks of a rank file, without special tokens. ids_sha256 is that of the decimal
    ids joined by one space, decoded_sha256 that of the bytes that the ids decode to. Null texts are empty: no ids. Rows that
    repeat and null ids are encoded each; an empty table gives no rows; other columns are not read.
    """
    path, split = default_ranks()
    path, split = ranks or path, pattern or split
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: tidy(_encoded(it, path, split, with_ids)), _DDL if with_ids else _DDL.rsplit(", ", 1)[0])


def decode_rows(coded: DataFrame, *, ids: str = "ids", ranks: str | None = None) -> DataFrame:
    """coded with a column decoded: the bytes of its array of ids (null: null)."""
    path = ranks or default_ranks()[0]

    @F.pandas_udf("binary")
    def joined(column):
        return column.map(lambda x: None if x is None else decode(np.asarray(x), load_merges(path)))

    return coded.withColumn("decoded", joined(F.col(ids)))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"))
