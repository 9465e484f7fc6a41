"""Sweeps of the plain topic model over packed documents: what a sweep moves are counts, not tokens.

Documents are packed once into compressed parts of about PART_TOKENS tokens, which then stay where they are. Before a sweep each part sends its
words with their counts, a compressed row for each bucket of words; the bucket adds them up and sends each part back the sums, in the order in
which the words came. A part's tokens are drawn in lanes from these. What a sweep leaves is a compressed number a token.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.operators import sparse_lda
from loomstat.scratch import cut, dealt

#: Parts whose words a bucket of words holds about as many of, and most buckets: a part sends a row to each.
BUCKET_PARTS, BUCKETS = 4, 512
_TOKENS = pa.schema([("doc", pa.string()), ("pos", pa.int64()), ("word", pa.string()), ("topic", pa.int32())])
_PACK = "part long, docs binary, doc_sizes binary, sizes binary, words binary, word_sizes binary, pos binary, topics binary, nt array<long>"


def squeeze(x: bytes | pa.Buffer) -> bytes:
    """x compressed, behind its length."""
    return len(x).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(x, asbytes=True)


def unsqueeze(x: bytes) -> bytes:
    return pa.Codec("zstd").decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True)


def squeeze_ints(x: np.ndarray) -> bytes:
    """Integers from 0, of the smallest type that they fit, the type's bytes in front."""
    kind = np.min_scalar_type(int(x.max()) if x.size else 0)
    return bytes([kind.itemsize]) + squeeze(np.ascontiguousarray(x, kind).tobytes())


def unsqueeze_ints(x: bytes) -> np.ndarray:
    return np.frombuffer(unsqueeze(x[1:]), f"u{x[0]}").astype(np.int64)


def squeeze_strings(x: pa.Array) -> tuple[bytes, bytes]:
    """Texts one behind the other, and their lengths plus 1 (0 is null)."""
    sizes = pc.add(pc.binary_length(x), 1).fill_null(0).to_numpy()
    x = x.fill_null("")
    ends = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1] if len(x) else np.zeros(1, np.int32)
    data = x.buffers()[2]
    return squeeze(data[int(ends[0]) : int(ends[-1])] if data is not None else b""), squeeze_ints(sizes)


def unsqueeze_strings(data: bytes, sizes: bytes) -> pa.Array:
    n = unsqueeze_ints(sizes)
    ends = np.r_[0, np.cumsum(np.maximum(n - 1, 0))].astype(np.int32)
    out = pa.StringArray.from_buffers(len(n), pa.py_buffer(ends.tobytes()), pa.py_buffer(unsqueeze(data)))
    return out if (n > 0).all() else pc.if_else(pa.array(n > 0), out, pa.scalar(None, pa.string()))


def _steps(pos: np.ndarray) -> np.ndarray:
    """Places as steps from one to the next, folded so that none is below 0."""
    d = np.diff(pos, prepend=0)
    return np.where(d >= 0, 2 * d, -2 * d - 1)


def _places(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(np.where(steps % 2, -(steps + 1) // 2, steps // 2))


def _packed(batches: Iterator[pa.RecordBatch], k: int, size: int) -> Iterator[pa.RecordBatch]:
    """Parts from tokens whose documents follow each other; a part ends with a document."""
    part, held, rows, limit = TaskContext.get().partitionId() << 32, [], 0, size

    def made(t: pa.Table) -> pa.RecordBatch:
        nonlocal part
        c = {n: t.column(n).combine_chunks() for n in t.column_names}
        first = np.flatnonzero(_turns(c["doc"]))
        topics = c["topic"].to_numpy().astype(np.int64) - 1
        docs, words = squeeze_strings(c["doc"].take(pa.array(first))), squeeze_strings(c["word"])
        row = [*docs, squeeze_ints(np.diff(np.r_[first, len(topics)])), *words, squeeze_ints(_steps(c["pos"].to_numpy())), squeeze_ints(topics)]
        out = [pa.array([part]), *[pa.array([x], pa.binary()) for x in row], pa.array([np.bincount(topics, minlength=k).tolist()], pa.list_(pa.int64()))]
        part += 1
        return pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in _PACK.split(", ")])

    for batch in batches:
        held.append(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, _TOKENS, strict=True)], schema=_TOKENS))
        rows += len(batch)
        if rows >= limit:
            t = pa.Table.from_batches(held)
            last = int(np.flatnonzero(_turns(t.column("doc").combine_chunks()))[-1])  # more of the last document may follow
            if last:
                yield made(t.slice(0, last))
                held, rows, limit = t.slice(last).to_batches(), rows - last, size
            limit = max(size, 2 * rows) if rows >= size else size
    if rows:
        yield made(pa.Table.from_batches(held))


def _turns(doc: pa.Array) -> np.ndarray:
    """Whether a token is its document's first."""
    x = doc.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.r_[True, x[1:] != x[:-1]]


def _vocabulary(words: pa.Array, buckets: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The number of each token's word, the words in order of bucket and text, and where buckets begin and end."""
    coded = words.dictionary_encode(null_encoding="encode")
    own = coded.dictionary
    bucket = np.fromiter((crc32(w or b"") % buckets for w in own.cast(pa.binary()).to_pylist()), np.int64, len(own))
    by = pc.sort_indices(pa.table({"bucket": bucket, "word": own}), sort_keys=[("bucket", "ascending"), ("word", "ascending")]).to_numpy()
    number = np.empty(len(by), np.int64)
    number[by] = np.arange(len(by))
    return number[coded.indices.to_numpy()], own.take(pa.array(by)), np.searchsorted(bucket[by], np.arange(buckets + 1))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(len(b)):
            yield {n: b.column(n)[i].as_py() for n in b.schema.names}


def _sent(batches: Iterator[pa.RecordBatch], k: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """A row for each part and bucket of words: the words and their topics' counts."""
    for r in _rows(batches):
        code, own, edges = _vocabulary(unsqueeze_strings(r["words"], r["word_sizes"]), buckets)
        counts = np.bincount(code * k + unsqueeze_ints(r["topics"]), minlength=len(own) * k).reshape(-1, k)
        at = [(b, lo, hi) for b, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if hi > lo]
        rows = [(b, r["part"], *squeeze_strings(own.slice(lo, hi - lo)), squeeze_ints(counts[lo:hi].T)) for b, lo, hi in at]
        yield pa.RecordBatch.from_pydict(dict(zip(("bucket", "part", "words", "word_sizes", "counts"), (pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _SENT, strict=True)), strict=True)))


_SENT = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())


def _added(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """For each part of a bucket the sums of its words over all parts; with part -1 how many words the bucket has."""
    held: list[dict] = []

    def sums() -> Iterator[pa.RecordBatch]:
        words = [unsqueeze_strings(r["words"], r["word_sizes"]) for r in held]
        coded = pa.concat_arrays(words).dictionary_encode(null_encoding="encode")
        code, n = coded.indices.to_numpy(), len(coded.dictionary)
        ends = np.cumsum([0, *map(len, words)]).tolist()
        total = np.zeros((k, n), np.int64)
        for r, lo, hi in zip(held, ends[:-1], ends[1:], strict=True):
            total[:, code[lo:hi]] += unsqueeze_ints(r["counts"]).reshape(k, -1)  # a part has a word once
        out = [(-1, held[0]["bucket"], b"", n - coded.dictionary.null_count)]
        out += [(r["part"], r["bucket"], squeeze_ints(total[:, code[lo:hi]]), 0) for r, lo, hi in zip(held, ends[:-1], ends[1:], strict=True)]
        held.clear()
        yield pa.RecordBatch.from_pydict(dict(zip(("part", "bucket", "counts", "vocabulary"), (pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.int64()), strict=True)), strict=True)))

    for r in _rows(batches):
        if held and held[0]["bucket"] != r["bucket"]:
            yield from sums()
        held.append(r)
    if held:
        yield from sums()


def _drawn(batches: Iterator[pa.RecordBatch], buckets: int, alpha: float, beta: float, nt: np.ndarray, vocabulary: int, seed: list[int]) -> Iterator[pa.RecordBatch]:
    k = len(nt)
    for r in _rows(batches):
        code, own, _ = _vocabulary(unsqueeze_strings(r["words"], r["word_sizes"]), buckets)
        counts = np.vstack([unsqueeze_ints(x["counts"]).reshape(k, -1).T for x in r["down"]]).astype(float)
        assert len(counts) == len(own)
        sizes, topics = unsqueeze_ints(r["sizes"]), unsqueeze_ints(r["topics"])
        docs = np.repeat(np.arange(len(sizes)), sizes)
        in_docs = np.bincount(docs * k + topics, minlength=len(sizes) * k).reshape(-1, k).astype(float)
        u = np.random.default_rng([*seed, r["part"]]).random(len(topics))
        topics = sparse_lda.lane_sweep(docs, code, topics, in_docs, counts, nt.copy(), alpha, beta, vocabulary * beta, u)
        yield pa.RecordBatch.from_arrays([pa.array([r["part"]]), pa.array([squeeze_ints(topics)], pa.binary()), pa.array([np.bincount(topics, minlength=k).tolist()], pa.list_(pa.int64()))], names=["part", "topics", "nt"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for r in _rows(batches):
        docs = unsqueeze_strings(r["docs"], r["doc_sizes"]).take(pa.array(np.repeat(np.arange(len(s := unsqueeze_ints(r["sizes"]))), s)))
        held = (docs, pa.array(_places(unsqueeze_ints(r["pos"]))), unsqueeze_strings(r["words"], r["word_sizes"]), pa.array((unsqueeze_ints(r["topics"]) + 1).astype(np.int32)))
        yield from pa.Table.from_arrays([*held], schema=_TOKENS).to_batches(max_chunksize=10_000)


def lda(tokens: DataFrame, sweeps: int, k: int, alpha: float, beta: float, seed: int, grouped: bool) -> DataFrame:
    """tokens (doc, pos, word, topic 1 .. k) after the sweeps.

    grouped: a document's tokens lie next to each other already, so that no token is moved.
    """
    size = sparse_lda.PART_TOKENS
    parts = max(1, -(-tokens.count() // size))
    if not grouped:
        tokens = tokens.repartition(parts, "doc").sortWithinPartitions("doc", "pos", "word")
    packs = tokens.select("doc", "pos", "word", "topic").mapInArrow(lambda it: _packed(it, k, size), _PACK)
    packs = dealt(packs, parts, "part")
    buckets, vocabulary, now = max(1, min(BUCKETS, -(-parts // BUCKET_PARTS))), None, packs.select("part", "topics", "nt")
    held = packs.drop("topics", "nt")
    with_topics = lambda: packs if vocabulary is None else held.join(now.repartition(parts, "part"), "part")
    for sweep in range(sweeps):
        total = {r["pos"]: r["n"] for r in now.select(F.posexplode("nt").alias("pos", "n")).groupBy("pos").agg(F.sum("n").alias("n")).collect()}  # a row a topic
        nt = np.array([total.get(t, 0) for t in range(k)], float)
        sent = with_topics().select("part", "words", "word_sizes", "topics").mapInArrow(lambda it: _sent(it, k, buckets), "bucket int, part long, words binary, word_sizes binary, counts binary")
        sums = cut(sent.repartition(buckets, "bucket").sortWithinPartitions("bucket", "part").mapInArrow(lambda it: _added(it, k), "part long, bucket int, counts binary, vocabulary long"))
        down = sums.where("part >= 0").repartition(parts, "part").groupBy("part").agg(F.sort_array(F.collect_list(F.struct("bucket", "counts"))).alias("down"))
        rows = with_topics().join(down, "part").select("part", "sizes", "words", "word_sizes", "topics", "down")
        vocabulary = vocabulary if vocabulary is not None else sums.agg(F.sum("vocabulary")).first()[0] or 0
        now = cut(rows.mapInArrow(lambda it, nt=nt, v=vocabulary, sweep=sweep: _drawn(it, buckets, alpha, beta, nt, v, [seed, sweep]), "part long, topics binary, nt array<long>"))
    return with_topics().select("docs", "doc_sizes", "sizes", "words", "word_sizes", "pos", "topics").mapInArrow(_unpacked, "doc string, pos long, word string, topic int")
