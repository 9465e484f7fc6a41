"""Media columns: content-addressed payloads in tar shards.

A payload is an 8-bit grey image WIDTH samples wide, stored losslessly as PNG. Every partition of the input makes one tar
shard; a payload is a member named by its digest and stored once a shard, and the rows, in the shard's last members, carry
doc_id, digest, offset and length. Metadata columns come from range reads of the image headers alone. Tar fills members
up to 512 bytes with zeros, so the byte 0 that ends each record is part of the format (a member whose size is a multiple
of 512 gets a small private chunk, so that there always is such a byte).
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .binfiles import open_ranges, read_at, shard_files, write_records
from .common import read, scratch_path

WIDTH = 64
BLOCK = 512
PNG = b"\x89PNG\r\n\x1a\n"
HEADER = 33  # signature and IHDR chunk
MAGIC = b"LMEDIA1\0"
TRAILER = struct.Struct("<8sQQ")
INDEX = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.binary()), ("offset", pa.int64()), ("length", pa.int64())])
LEVEL = 6


def padded(data: bytes) -> bytes:
    """data with bytes 0 up to a positive multiple of WIDTH."""
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """The payload, a positive multiple of WIDTH long, as grey samples in rows of WIDTH."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)  # a filter byte 0 before each row
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    parts = [PNG, _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)), _chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)), _chunk(b"IEND", b"")]
    if sum(map(len, parts)) % BLOCK == 0:
        parts.insert(2, _chunk(b"loPd", b"\0"))
    return b"".join(parts)


def png_header(data: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample from the first HEADER bytes."""
    if data[:8] != PNG or data[12:16] != b"IHDR":
        raise ValueError("no PNG header")
    return struct.unpack(">IIB", data[16:25])


def from_png(data: bytes) -> bytes:
    """The samples of an image that to_png() made."""
    width, height, _ = png_header(data)
    at, packed = 8, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + size])
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    return rows[:, 1:].tobytes()


def _member(name: str, data: bytes) -> bytes:
    """Header, data and zeros of a tar member but for the last zero. len(data) is no multiple of BLOCK."""
    info = tarfile.TarInfo(name)
    info.size = len(data)
    return info.tobuf(tarfile.USTAR_FORMAT) + data + bytes(-len(data) % BLOCK - 1)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to the records of one tar shard."""
    out = lambda data: pa.RecordBatch.from_arrays([pa.array(data, pa.binary())], names=["record"])
    seen: dict[bytes, tuple[bytes, int, int]] = {}
    index: list[tuple] = []
    at = 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = (text.as_py() or "").encode()
            key = hashlib.sha256(data).digest()
            if key not in seen:
                media = to_png(padded(data))
                digest = hashlib.sha256(media).digest()
                record = _member(f"{digest.hex()}.png", media)
                seen[key] = digest, at + BLOCK, len(media)
                at += len(record) + 1
                yield out([record])
            index.append((doc_id, len(data), *seen[key]))
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, INDEX) as w:
        w.write_batch(pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*index, strict=True) if index else [[]] * 5, INDEX, strict=True)], schema=INDEX))
    rows = sink.getvalue()
    member = _member("rows.arrow", rows + bytes(len(rows) % BLOCK == 0))
    yield out([member, _member("trailer", TRAILER.pack(MAGIC, at + BLOCK, len(rows))), bytes(2 * BLOCK - 1)])


def write_media(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text") -> None:
    """Store every text (null: empty) as media in tar shards at path, one for each input partition, without any shuffle.

    Equal texts of a shard are stored once. Rows that repeat, null ids and empty tables are fine; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    write_records(rows.mapInArrow(_records, "record binary"), path, "\0")


def shard_rows(file, length: int) -> pa.Table:
    """The rows of a shard (INDEX), by two range reads at its end."""
    magic, at, size = TRAILER.unpack(read_at(file, length - 3 * BLOCK, TRAILER.size))
    if magic != MAGIC:
        raise ValueError("no media shard")
    return pa.ipc.open_stream(read_at(file, at, size)).read_all()


def _by_payload(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The open file, the shard and the rows of each stored payload, in file order."""
    for batch in batches:
        for shard, path, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            with open_ranges(path) as file:
                rows = shard_rows(file, length).sort_by("offset").to_pylist()
                for _, same in groupby(rows, key=lambda r: r["offset"]):
                    yield file, shard, list(same)


def _emit(found: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in found:
        held.append(row)
        if len(held) == 4096:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


COLUMNS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("shard", pa.int64()), ("digest", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("width", pa.int64()), ("height", pa.int64()), ("bits", pa.int64())])
COLUMNS_DDL = "doc_id long, n_bytes long, shard long, digest string, offset long, length long, width long, height long, bits long"
FEATURES = pa.schema([*COLUMNS, ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
FEATURES_DDL = COLUMNS_DDL + ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string"


def _located(file, shard: int, row: dict) -> dict:
    width, height, bits = png_header(read_at(file, row["offset"], HEADER))
    return {"shard": shard, "digest": row["digest"].hex(), "offset": row["offset"], "length": row["length"], "width": width, "height": height, "bits": bits}


def media_columns(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_bytes, shard, digest, offset, length, width, height, bits: reads the rows and HEADER bytes a payload, no payloads."""

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _emit(({"doc_id": r["doc_id"], "n_bytes": r["n_bytes"]} | head for file, shard, same in _by_payload(it) for head in [_located(file, shard, same[0])] for r in same), COLUMNS)

    return shard_files(spark, path).mapInArrow(rows, COLUMNS_DDL)


def media_features(spark: SparkSession, path: str) -> DataFrame:
    """The columns of media_columns() with digests, checksum and a feature of the samples, computed from the stored bytes."""

    def one(file, shard: int, row: dict) -> dict:
        head = _located(file, shard, row)
        media = read_at(file, row["offset"], row["length"])
        digest = hashlib.sha256(media).hexdigest()
        if digest != head["digest"]:
            raise ValueError(f"a payload of shard {shard} is damaged")
        payload = from_png(media)
        counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
        feature = f"{head['width']}x{head['height']}x{head['bits']} sum={int((counts * np.arange(256)).sum())} values={int((counts > 0).sum())}"
        return head | {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-WIDTH:]), "media_sha256": digest, "feature": feature}

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _emit(({"doc_id": r["doc_id"], "n_bytes": r["n_bytes"]} | facts for file, shard, same in _by_payload(it) for facts in [one(file, shard, same[0])] for r in same), FEATURES)

    return shard_files(spark, path).mapInArrow(rows, FEATURES_DDL)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "media")
    write_media(read(spark, sf_dir, "documents"), path)
    out = media_features(spark, path)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"), "media_sha256", "feature", "shard", "offset", "width", "height")
