"""Token id files: every document a zstandard frame of its own under one shared dictionary.

A shard file holds, each followed by a byte 10:
  header   magic, id width, dictionary hash, dictionary length, dictionary
  frames   one for each document in ascending doc_id order, its ids as little-endian integers
  index    doc_id, null flag, frame offset, frame length, ids before, ids, as columns of fixed width
  tail     index offset, documents, ids, dictionary hash, magic (TAIL bytes)
A document is read by its index entry and one frame; the dictionary hash in the tail says which dictionary it needs.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .binfiles import open_ranges, read_at, shard_files, write_records
from .common import partitions_for, read, scratch_path, small, tidy
from .tokens import END_ID, encoder, tokenizer_path

MAGIC = b"LTIDS\x01"
HEAD, TAIL = struct.Struct("<6sBQI"), struct.Struct("<QQQQ6s")
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("length", "<u4"), ("start", "<u8"), ("ids", "<u8")])
SHARD_BYTES = 24 << 20
LEVEL = 2
#: The dictionary is trained on so many documents at most, the first in order of their hash, and on so many characters of each at
#: most; all documents are written whole.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 1024, 1 << 14, 1 << 16


def train_dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary; of too few samples to train on, their own bytes."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def _records(batches: Iterator[pa.RecordBatch], path: str, end_id: int, dictionary: bytes) -> Iterator[pa.RecordBatch]:
    """Sorted (doc_id, text) to the records of one shard file."""
    out = lambda data: pa.RecordBatch.from_arrays([pa.array(data, pa.binary())], names=["record"])
    enc = encoder(path)
    end, width = enc._pack([end_id]), enc.width
    check = xxhash.xxh64_intdigest(dictionary)
    head = HEAD.pack(MAGIC, width, check, len(dictionary)) + dictionary
    yield out([head])
    squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary))
    at, start, index = len(head) + 1, 0, []
    for batch in batches:
        for lo in range(0, len(batch), 512):
            part = batch.slice(lo, 512)
            frames = []
            for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist()), strict=True):
                ids += end
                frames.append(squeeze.compress(ids))
                n = len(ids) // width
                index.append((doc_id or 0, doc_id is None, at, len(frames[-1]), start, n))
                at, start = at + len(frames[-1]) + 1, start + n
            yield out(frames)
    yield out([np.array(index, INDEX).tobytes(), TAIL.pack(at, len(index), start, check, MAGIC)])


def write_token_files(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encode every text (null: empty) with its end id and write shard files to path in ascending doc_id order, null last.

    Rows repeated with one doc_id are written each, by the hash of their text; an empty table gives shards without
    documents. Other columns are not read.
    """
    tokenizer = tokenizer or tokenizer_path()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ids = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).distinct()
    chosen = rows.join(F.broadcast(ids), "doc_id").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"), "text")  # SAMPLE_DOCS ids at most
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(SAMPLE_DOCS)
    sample = chosen.select("n", F.substring("text", 1, SAMPLE_CHARS).alias("text")).toPandas()
    dictionary = train_dictionary([x for x in encoder(tokenizer).encode(sample["text"].dropna().tolist()) if x])
    size = rows.count() * float(sample["n"].mean() if len(sample) else 0)  # about the bytes of all texts, for the number of shards alone
    shards = partitions_for(size, SHARD_BYTES)
    ordered = rows.repartitionByRange(shards, F.col("doc_id").asc_nulls_last())
    ranged = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    write_records(ranged.mapInArrow(lambda it: tidy(_records(it, tokenizer, end_id, dictionary)), "record binary"), path, "\n")


class TokenFile:
    """One shard: its index at once, documents by range reads."""

    def __init__(self, path: str, length: int | None = None):
        self.file = open_ranges(path)
        length = length or self.file.size()
        at, n, self.total, check, magic = TAIL.unpack(read_at(self.file, length - 1 - TAIL.size, TAIL.size))
        head = read_at(self.file, 0, HEAD.size)
        magic_too, self.width, check_too, size = HEAD.unpack(head)
        if (magic, magic_too) != (MAGIC, MAGIC) or check != check_too:
            raise ValueError(f"{path} is no token id file")
        data = read_at(self.file, HEAD.size, size)
        if xxhash.xxh64_intdigest(data) != check:
            raise ValueError(f"{path} has another dictionary than its frames need")
        self.index = np.frombuffer(read_at(self.file, at, n * INDEX.itemsize), INDEX)
        self.expand = zstandard.ZstdDecompressor(dict_data=_dictionary(data))

    def ids(self, entry: int) -> np.ndarray:
        """The ids of the document at this place in the index."""
        row = self.index[entry]
        data = self.expand.decompress(read_at(self.file, int(row["offset"]), int(row["length"])))
        return np.frombuffer(data, f"<u{self.width}").astype("<u4")

    def find(self, doc_id: int) -> np.ndarray:
        """The ids of a document by its id."""
        known = self.index[self.index["null"] == 0]
        at = int(np.searchsorted(known["doc_id"], doc_id))
        if at == len(known) or known["doc_id"][at] != doc_id:
            raise KeyError(doc_id)
        return self.ids(at)


def _read_rows(batches: Iterator[pa.RecordBatch], with_ids: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, path, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            shard_file = TokenFile(path, length)
            for lo in range(0, len(shard_file.index), 1024):
                part = shard_file.index[lo : lo + 1024]
                ids = [shard_file.ids(lo + i) for i in range(len(part))]
                arrays = [pa.array(np.full(len(part), shard)), pa.array(part["doc_id"].copy(), mask=part["null"].astype(bool)), pa.array(part["start"].astype(np.int64)), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())]
                if with_ids:
                    arrays.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)
            shard_file.file.close()


def _total_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, path, length) to the shard's number of ids, from the tails alone."""
    for batch in batches:
        sums = []
        for path, length in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            with open_ranges(path) as file:
                sums.append(TAIL.unpack(read_at(file, length - 1 - TAIL.size, TAIL.size))[2])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.int64())], names=["shard", "ids"])


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids of every document in the files at path."""
    files = shard_files(spark, path)
    fields = [("shard", pa.int64()), ("doc_id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids
    schema = pa.schema(fields)
    ddl = "shard long, doc_id long, local long, n_tokens long, ids_crc32 long" + ", ids array<bigint>" * with_ids
    rows = files.mapInArrow(lambda it: _read_rows(it, with_ids, schema), ddl)
    before = F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # a row a file
    starts = files.mapInArrow(_total_rows, "shard long, ids long").select("shard", F.coalesce(before, F.lit(0)).alias("base"))
    out = rows.join(small(starts, files.count()), "shard").withColumn("start", F.col("base") + F.col("local"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write_token_files(read(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path, with_ids=False)
