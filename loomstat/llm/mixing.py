"""Mixing sources to target weights by pivotal dependent rounding.

Each source's documents get the same expected number of copies, target / source size. The whole part is
taken as it is; the fractional parts are rounded in pairs: mass moves from one partner to the other, in
the direction that a coin weighted to keep both expectations picks, until one of the two is whole, and
the amounts moved keep the pair's expected number of words. Chunks of a source, sorted by falling size,
do that in one pass each, where a document's partner is the pool of the smaller ones after it; the
document that each chunk has left goes up a reduction tree, paired with those of other chunks, until a
source has a single one, which a last coin rounds. So a source misses its target by less than the size
of one document, and the falling order makes that a small one unless one document outweighs the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, materialize, read, small

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_COPIES = 2.0
CHUNK_ROWS = 5_000
FAN_IN = 64
SEED = 20240601
MASK = (1 << 64) - 1


def coin(a: int, b: int, seed: int) -> float:
    """A number in [0, 1) that depends on nothing but the two keys and the seed."""
    x = (a * 0x9E3779B97F4A7C15 ^ b * 0xC2B2AE3D27D4EB4F ^ seed) & MASK
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & MASK
    return ((x ^ x >> 31) >> 11) / (1 << 53)


def settle_pair(p: float, s: float, q: float, t: float, u: float) -> tuple[float, float]:
    """Move mass between probabilities p of a document of size s and q of one of size t; keeps p*s + q*t, makes one whole."""
    up, down = min(1 - p, q * t / s), min(p, (1 - q) * t / s)
    if u * (up + down) < down:
        return (1.0, q - up * s / t) if up == 1 - p else (p + up, 0.0)
    return (0.0, q + down * s / t) if down == p else (p - down, 1.0)


def _snap(p: float) -> float:
    return 0.0 if p < 1e-12 else 1.0 if p > 1 - 1e-12 else p


def _with(batch: pa.RecordBatch, p: np.ndarray, pending: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(p, pa.float64()), pa.array(pending, pa.bool_())], schema=batch.schema)


def _round_pools(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """First level, rows sorted by (rank, chunk, weight falling), all of a chunk with the same p.

    A document's partner is the pool of all smaller ones of its chunk, whose probabilities q move together. So it becomes
    whole at once unless the pool does, which only a document larger than the whole pool's slack can bring about: that one
    stays pending, and the rest of the chunk is whole.
    """
    group, q, pool = None, 0.0, 0.0
    for batch in batches:
        rank, chunk, own, weight, total = (batch.column(n).to_numpy() for n in ("rank", "chunk", "own", "weight", "pool"))
        p, pending = batch.column("p").to_numpy().copy(), np.zeros(len(batch), bool)
        for i in range(len(p)):
            if group != (rank[i], chunk[i]):
                group, q, pool = (rank[i], chunk[i]), _snap(float(p[i])), float(total[i])
            size = float(weight[i])
            if size <= 0:
                p[i] = float(coin(int(own[i]), 2, seed) < p[i])
                continue
            pool = max(0.0, pool - size)
            if q in (0.0, 1.0):
                p[i] = q
            elif pool < 0.5:
                p[i], pending[i] = q, True
            else:
                x, q = (_snap(v) for v in settle_pair(q, size, q, pool, coin(int(own[i]), 3, seed)))
                p[i], pending[i] = x, x not in (0.0, 1.0)
        yield _with(batch, p, pending)


def _round_pairs(batches: Iterator[pa.RecordBatch], seed: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Upper levels, rows sorted by (rank, chunk, weight falling): one row a chunk stays pending, none if last."""
    group, held = None, None  # held: the row, its p, weight and own

    def released(pending: bool) -> pa.RecordBatch:
        row, p, _, own = held
        if last and pending:
            p, pending = float(coin(own, 1, seed) < p), False
        return _with(row, np.array([p]), np.array([pending]))

    for batch in batches:
        rank, chunk, own, p, weight = (batch.column(n).to_numpy() for n in ("rank", "chunk", "own", "p", "weight"))
        for i in range(len(p)):
            row, new = batch.slice(i, 1), [float(p[i]), float(weight[i]), int(own[i])]
            if group != (rank[i], chunk[i]):
                if held:
                    yield released(True)
                group, held = (rank[i], chunk[i]), [row, *new]
                continue
            if held is None:
                held = [row, *new]
                continue
            held[1], new[0] = (_snap(v) for v in settle_pair(held[1], held[2], new[0], new[1], coin(held[3], new[2], seed)))
            if held[1] in (0.0, 1.0):
                yield released(False)
                held = [row, *new]
                if new[0] in (0.0, 1.0):
                    yield released(False)
                    held = None
            else:
                yield _with(row, np.array([new[0]]), np.array([False]))
    if held:
        yield released(True)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """source, rank, source_size, target for a row a source of (source, source_size).

    Sources in code point order, null last, get the weights in turn and share `share` times all sizes by weight, none more
    than `most` times its size. The level that shares out the rest is, over all cuts of the order by most * size / weight,
    the largest (total - capped before the cut) / (weight from the cut on). The windows here see one row a source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("rank", rank).withColumn("w", weight).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy()) * share
    t = t.withColumn("level", (total - before) / rest)
    level = F.max("level").over(Window.partitionBy())
    return t.withColumn("level", level).select("source", "rank", "source_size", F.least(F.col("cap"), F.col("level") * F.col("w")).cast("double").alias("target"))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES, seed: int = SEED, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies, own (the row's key).

    One row for each row of docs. size counts the text's words (null: 0). Copies are whole, at most `most` rounded up, and
    fixed by seed and rows alone. Documents without words take no part in the balance and are rounded each by its own
    coin; in a source without any words they stay once. Rows alike in doc_id, text and source are decided alike. Null
    sources are a source of their own; null doc_ids and empty tables are fine. Other columns are not read.
    """
    sized = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        row_key(F.col(doc_id), F.col(text), F.col(source)).alias("own"),
    )
    items = materialize(sized.groupBy("own", "doc_id", "source", "size").agg(F.count("*").alias("m")), "mix-items")
    sizes = items.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("n"))
    goal = materialize(targets(sizes, weights, share, most), "mix-targets")
    n_items, n_sources = items.count(), goal.count()
    chunks = max(1, -(-n_items // chunk_rows))
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    goal = goal.withColumn("wanted", copies)
    items = items.join(small(goal, n_sources), items["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    base = F.floor(F.col("wanted") + 1e-9)
    level = items.select(
        "own", "doc_id", "source", "size", "m", "source_size", "target", base.cast("long").alias("base"), "rank", F.pmod(F.xxhash64("own"), F.lit(chunks)).alias("chunk"),
        (F.col("size") * F.col("m")).cast("double").alias("weight"), F.greatest(F.lit(0.0), F.col("wanted") - base).alias("p"), F.lit(False).alias("pending"),
    )
    order = ["rank", "chunk", F.col("weight").desc(), "own", "doc_id"]
    pool = F.sum("weight").over(Window.partitionBy("rank", "chunk"))
    dealt = level.repartition("rank", "chunk").withColumn("pool", pool).select("pool", *level.columns).sortWithinPartitions(*order)
    level = materialize(dealt.mapInArrow(lambda it: _round_pools(it, seed), dealt.schema), "mix-level").drop("pool")
    done = level.where("NOT pending")
    while True:
        chunks = -(-chunks // FAN_IN)
        last = chunks == 1
        dealt = level.where("pending").withColumn("chunk", F.floor(F.col("chunk") / FAN_IN).cast("long"))
        dealt = dealt.repartition("rank", "chunk").sortWithinPartitions(*order)
        level = materialize(dealt.mapInArrow(lambda it, last=last: _round_pairs(it, seed, last), dealt.schema), "mix-level")
        done = done.unionByName(level.where("NOT pending"))
        if last:
            break
    done = done.withColumn("copies", F.col("base") + F.col("p").cast("long"))
    return done.select("doc_id", "source", "size", "source_size", "target", "copies", "own", F.explode(F.expr("sequence(1L, m)")).alias("k")).drop("k")


def row_key(doc_id, text, source):
    return F.xxhash64(doc_id, F.coalesce(text, F.lit("")), source)


def take(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of docs as often as mix() says, with the columns of docs; mix() tells about nulls and repeats."""
    doc_id, text, source = (options.get(k, k) for k in ("doc_id", "text", "source"))
    own, copies, k = (fresh(docs, name) for name in ("own", "copies", "k"))
    counts = mix(docs, **options).select(F.col("own").alias(own), F.col("copies").alias(copies)).dropDuplicates([own])
    keyed = docs.withColumn(own, row_key(F.col(doc_id), F.col(text), F.col(source)))
    taken = keyed.join(counts, own).where(F.col(copies) > 0).withColumn(k, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
    return taken.drop(own, copies, k)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
