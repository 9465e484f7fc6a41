"""Maximum inner product search with score-aware anisotropic quantisation.

Vectors are cut into two-dimensional pieces with 16 code words each, four bits a piece. Code words and codes
minimise |r|^2 + (eta - 1) (r . x/|x|)^2 for the residual r of vector x: the part of r along x, which
shifts the scores of just those queries that x is near to, costs eta times the rest. A scan adds up
table entries for two pieces at a time (one byte, 256 entries), keeps the best DEPTH candidates of a
block with all ties, and reranks them exactly on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, partitions_for, read

NEAREST = 20
QUERY_EVERY = 20
#: Candidates of a block (for each query) that are reranked.
DEPTH = 128
#: Code words are trained on so many vectors at most; every vector is encoded and searched.
TRAIN_ROWS = 4096
THRESHOLD = 0.2
WORDS, PIECE = 16, 2
#: A task holds one block of candidates; the queries of a block stream past it, so their number costs no memory.
CANDIDATE_BLOCK, QUERY_BLOCK, SCAN_QUERIES = 8192, 65536, 128


def _pieces(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x and its unit vectors in pieces, padded with zeros to whole bytes of two pieces."""
    d = -x.shape[1] % (2 * PIECE)
    x = np.pad(x.astype(np.float64), ((0, 0), (0, d)))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return (v.reshape(len(x), -1, PIECE) for v in (x, unit))


def encode(x: np.ndarray, words: np.ndarray, eta: float, sweeps: int = 2) -> np.ndarray:
    """Codes (n x pieces) by coordinate descent on the anisotropic loss."""
    x, unit = _pieces(x)
    n, m = x.shape[:2]
    codes = np.stack([((x[:, s, None] - words[s]) ** 2).sum(2).argmin(1) for s in range(m)], 1)
    along = ((x - words[np.arange(m), codes]) * unit).sum(2)
    total = along.sum(1)
    for _ in range(sweeps):
        for s in range(m):
            rest = total - along[:, s]
            r = x[:, s, None] - words[s]
            par = (r * unit[:, s, None]).sum(2)
            codes[:, s] = ((r**2).sum(2) + (eta - 1) * (rest[:, None] + par) ** 2).argmin(1)
            along[:, s] = par[np.arange(n), codes[:, s]]
            total = rest + along[:, s]
    return codes.astype(np.uint8)


def train(x: np.ndarray, eta: float, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Code words (pieces x WORDS x PIECE): encoding and weighted least squares in turn."""
    rng = np.random.default_rng(seed)
    pieces, unit = _pieces(x)
    n, m = pieces.shape[:2]
    words = np.stack([pieces[rng.choice(n, WORDS, replace=n < WORDS), s] for s in range(m)])
    for _ in range(rounds):
        codes = encode(x, words, eta)
        along = ((pieces - words[np.arange(m), codes]) * unit).sum(2)
        for s in range(m):
            rest = along.sum(1) - along[:, s]
            for k in np.unique(codes[:, s]):
                of = codes[:, s] == k
                u, v = unit[of, s], pieces[of, s]
                left = of.sum() * np.eye(PIECE) + (eta - 1) * u.T @ u
                right = v.sum(0) + (eta - 1) * u.T @ (rest[of] + (u * v).sum(1))
                words[s, k] = np.linalg.solve(left, right)
            along[:, s] = ((pieces[:, s] - words[s, codes[:, s]]) * unit[:, s]).sum(1)
    return words


def usable(vector: Column, dims: int) -> Column:
    """Neither null nor zero, of the table's dimension, all components finite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce((F.size(vector) == dims) & F.forall(vector, fine) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _encoded(batches: Iterator[pa.RecordBatch], schema: pa.Schema, words: np.ndarray, eta: float, dims: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.array(batch.column(2).to_pylist(), np.float64).reshape(-1, dims)
        if len(x):
            codes = encode(x, words, eta)
            packed = codes[:, 0::2] << 4 | codes[:, 1::2]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in packed], pa.binary()), pa.array([v.tobytes() for v in x], pa.binary())], schema=schema)


def _scan(batches: Iterator[pa.RecordBatch], schema: pa.Schema, words: np.ndarray, dims: int, k: int, depth: int) -> Iterator[pa.RecordBatch]:
    """Cells of candidates (kind 0) and queries (kind 1), sorted by cell and kind, to the k nearest of the cell for each query."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(n).to_pylist() for n in ("cell", "kind", "vec_id", "code", "vector")), strict=True)

    def matrix(part: Sequence[tuple]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([r[2] for r in part], np.int64), np.frombuffer(b"".join(r[4] for r in part), np.float64).reshape(-1, dims)

    for _, cell in groupby(rows(), key=lambda r: r[0]):
        held = None
        for kind, part in groupby(cell, key=lambda r: r[1]):
            if kind == 0:
                block = list(part)
                held = *matrix(block), np.frombuffer(b"".join(r[3] for r in block), np.uint8).reshape(len(block), -1)
                del block
            elif held is not None:
                while asked := list(islice(part, SCAN_QUERIES)):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in _nearest(*matrix(asked), *held, words, k, depth)], schema=schema)


def _nearest(ids: np.ndarray, xs: np.ndarray, c_ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, words: np.ndarray, k: int, depth: int) -> list[np.ndarray]:
    """query_id, vec_id, score of each query's k nearest candidates: table sums over the codes, then exact scores of the best depth."""
    padded = np.pad(xs, ((0, 0), (0, -xs.shape[1] % (2 * PIECE)))).reshape(len(xs), -1, PIECE)
    table = np.einsum("qmd,mwd->qmw", padded, words).astype(np.float32)
    table = (table[:, 0::2, :, None] + table[:, 1::2, None, :]).reshape(len(xs), -1, 256)
    score = np.zeros((len(xs), len(c_ids)), np.float32)
    for b in range(codes.shape[1]):
        score += np.take(table[:, b], codes[:, b], axis=1)
    score[ids[:, None] == c_ids[None]] = -np.inf
    bar = np.partition(score, -depth, axis=1)[:, -depth] if len(c_ids) > depth else np.full(len(xs), -np.finfo(np.float32).max)
    out = []
    for i in range(len(ids)):
        best = np.flatnonzero((score[i] >= bar[i]) & (c_ids != ids[i]))
        exact = (vectors[best] * xs[i]).sum(1)
        order = np.lexsort((c_ids[best], -exact))[:k]
        out.append((np.full(len(order), ids[i]), c_ids[best][order], exact[order]))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def search(vectors: DataFrame, is_query: Column, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = NEAREST, depth: int = DEPTH, threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates with the largest inner products found for each query row.

    is_query marks query rows; every other row of another vec_id is a candidate. Scores are exact, in
    double precision on the original vectors; ties go to the smaller vec_id. Vectors that are null, zero, not of the most
    frequent length, or hold null, NaN or infinite components take no part, and neither do null ids. Fewer candidates than
    k are all returned. Equal vectors get equal codes, and all ties with the last kept are reranked, so copies are found
    in order of vec_id. Rows repeated with one vec_id appear as often;
    of query rows with one vec_id and several vectors the least, as bytes, asks. An empty table gives no rows; other columns are
    not read.

    Candidates lie in blocks of about CANDIDATE_BLOCK rows and queries in blocks of about QUERY_BLOCK; each pair of blocks is
    one cell of work, which holds the candidates, lets the queries stream past and hands on k rows a query. Vectors travel with
    the codes: for each pair of a query and a candidate that is a 65,536th of a candidate and an 8,192nd of a query, where
    codes alone and a later join of vectors would send DEPTH pairs a cell and query on, a 64th of all pairs.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    sizes = rows.where("size(v) > 0").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    out_schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], out_schema)
    dims = sizes["d"]
    rows = rows.where(usable(F.col("v"), dims))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(train_rows).select("v").toPandas()["v"]
    if not len(sample):
        return spark.createDataFrame([], out_schema)
    eta = max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2))
    words = train(np.array(sample.tolist(), np.float64), eta)

    coded = pa.schema([("vec_id", pa.int64()), ("is_query", pa.bool_()), ("code", pa.binary()), ("vector", pa.binary())])
    codes = rows.select("vec_id", "is_query", "v").mapInArrow(lambda it: _encoded(it, coded, words, eta, dims), "vec_id long, is_query boolean, code binary, vector binary")
    codes = materialize(codes, "ann-codes")
    asked = codes.where("is_query")
    n, n_queries = codes.count(), asked.count()
    c_blocks, q_blocks = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    c_block, q_block = F.pmod(F.xxhash64("vec_id"), F.lit(c_blocks)), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(q_blocks))
    everywhere = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = asked.groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("c", everywhere(c_blocks)).select((F.col("c") * q_blocks + q_block).alias("cell"), F.lit(1).alias("kind"), "vec_id", F.lit(None).cast("binary").alias("code"), "vector")
    right = codes.withColumn("q", everywhere(q_blocks)).select((c_block * q_blocks + F.col("q")).alias("cell"), F.lit(0).alias("kind"), "vec_id", "code", "vector")
    cells = left.unionByName(right).repartition(partitions_for(c_blocks * q_blocks, 1), "cell").sortWithinPartitions("cell", "kind", "vec_id")
    found = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    near = cells.mapInArrow(lambda it: _scan(it, found, words, dims, k, depth), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)
